"""Edit logs and events as streams.

``follow`` keeps, per operation, only its lowest sequence and its latest undo or redo, so that late, repeated and
unordered rows change nothing that the batch fold would not change; state is keyed by operation, never by session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborline.common import normal_key

OUT = "session_id string, operation_id string, type string, t long, in_force boolean"


def follow(ops: DataFrame) -> DataFrame:
    """A stream of ``session_id, operation_id, type, t, in_force``: each operation again whenever its state changes (update mode)."""
    event = normal_key("event")
    rows = ops.filter(F.col("sequence").isNotNull() & event.isin("apply", "undo", "redo")).select(
        "session_id", F.when(event == "apply", F.col("operation_id")).otherwise(F.col("target_operation_id")).alias("operation_id"), event.alias("event"), normal_key("type").alias("type"), F.col("sequence").alias("t")
    ).filter("operation_id is not null")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        applied, kind, toggled, on = state.get if state.exists else (-1, "", -1, True)
        before = (applied, kind, toggled, on)
        for batch in batches:
            for r in batch.itertuples():
                if r.event == "apply":
                    if applied < 0 or r.t < applied:
                        applied, kind = int(r.t), r.type or ""
                elif r.t > toggled:
                    toggled, on = int(r.t), r.event == "redo"
        state.update((applied, kind, toggled, on))
        if applied >= 0 and (applied, kind, toggled, on) != before:
            yield pd.DataFrame([(*key, kind, applied, on or toggled < applied)], columns=["session_id", "operation_id", "type", "t", "in_force"])

    return rows.groupBy("session_id", "operation_id").applyInPandasWithState(fold, OUT, "applied long, type string, toggled long, is_on boolean", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """The operations in force after a table of updates with their batch number: the last update of each counts."""
    last = updates.groupBy("session_id", "operation_id").agg(F.max(F.struct("batch", "type", "t", "in_force")).alias("u"))
    return last.filter("u.in_force").select("session_id", "operation_id", "u.t", "u.type")


def windows(events: DataFrame, size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events per sliding window and type, with a watermark for late rows; the same plan in batch and stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "event_type", "n", "total")
