"""A change feed applied to a table: which operations are in force, and the state after all of them.

Last writer wins, column by column: of each field the change with the greatest sequence counts, if it lies after the
latest removal of its row. Links to rows that were removed after the link was set are then followed to where the
removal moved them. Everything is joins, aggregates and windows; no session passes through one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborline.common import normal_key, running, stored

#: The time of the state before the log.
BEFORE = -(2**62)


def in_force(ops: DataFrame, baselines: DataFrame) -> DataFrame:
    """The operations in force at the end of the log, each once.

    ``ops``: session_id, baseline_fingerprint, event, operation_id, target_operation_id, sequence, type, arguments.
    ``baselines``: session_id, baseline_fingerprint. Rows of another baseline, without a sequence or without an id do
    not count. An operation is applied at its lowest sequence; the latest undo or redo of it after that decides. Returns
    ``session_id, operation_id, t, type, arguments...`` as ``root_id, parent_id, source_id``. Repeats change nothing,
    since only minima and maxima are taken.
    """
    event = normal_key("event")
    kind = normal_key("type")
    a = F.col("arguments")
    parent = F.when(kind == "create_root", a["parent_id"]).when(kind == "reparent_root", a["new_parent_id"])
    mark = F.unhex(F.md5("baseline_fingerprint")).alias("mark")
    rows = ops.filter(F.col("sequence").isNotNull() & event.isin("apply", "undo", "redo")).select(
        "session_id", mark, event.alias("event"), F.when(event == "apply", F.col("operation_id")).otherwise(F.col("target_operation_id")).alias("operation_id"),
        F.col("sequence").alias("t"), kind.alias("type"), a["root_id"].alias("root_id"), parent.alias("parent_id"), F.when(kind == "merge_roots", a["source_root_id"]).alias("source_id"),
    )
    known = baselines.select("session_id", mark).distinct()
    rows = rows.filter(F.col("operation_id").isNotNull()).join(known, ["session_id", "mark"], "left_semi")
    applied = F.when(F.col("event") == "apply", F.struct("t", "type", "root_id", "parent_id", "source_id"))
    toggled = F.when(F.col("event") != "apply", F.struct("t", F.col("event")))
    per = rows.groupBy("session_id", "operation_id").agg(F.min(applied).alias("a"), F.max(toggled).alias("u"))
    on = F.col("a").isNotNull() & (F.col("u").isNull() | (F.col("u.event") == "redo") | (F.col("u.t") < F.col("a.t")))
    return per.filter(on).select("session_id", "operation_id", "a.*")


def _first_after(probes: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``d``, the time of the first event of (session_id, at) after ``t``; an as-of join as a union and a running value.

    ``probes`` have session_id, at, t and further columns; ``events`` session_id, at, d. The rows of one key, however many,
    lie in ranges of time (see ``running``).
    """
    rest = [c for c in probes.columns if c not in ("session_id", "at", "t")]
    left = probes.select("session_id", "at", (-F.col("t")).alias("before"), F.lit(0).alias("event"), F.struct(F.col("t"), *rest).alias("p"), F.lit(None).cast("long").alias("d"))
    right = events.select("session_id", "at", (-F.col("d")).alias("before"), F.lit(1).alias("event"), F.lit(None).cast(left.schema["p"].dataType).alias("p"), F.col("d"))
    seen = running(left.unionByName(right), ["session_id", "at"], ["before", "event"], "d", "next", "last")
    return seen.filter("event = 0").select("session_id", "at", "p.*", F.col("next").alias("d"))


def replay(ops: DataFrame, label_map: DataFrame) -> DataFrame:
    """The tree of each session after its whole log: ``session_id, root_id, parent_id, last_operation_id``, all roots alive.

    ``label_map``: session_id, baseline_fingerprint, numeric_label, root_id, parent_id; labels below 0 and null are no
    roots. A session without operations comes out as it was; operations on roots that are not there change nothing; an
    empty log or map gives the other or nothing.
    """
    start = label_map.filter("numeric_label >= 0 and root_id is not null and session_id is not null")
    force = stored(in_force(ops, label_map.filter("session_id is not null")))
    base = start.groupBy("session_id", "root_id").agg(F.max("parent_id").alias("parent_id"))
    none = F.lit(None).cast("string")
    writes = base.select("session_id", "root_id", F.lit(BEFORE).cast("long").alias("t"), F.lit(True).alias("births"), "parent_id", none.alias("operation_id")).unionByName(
        force.filter(F.col("type").isin("create_root", "reparent_root")).select("session_id", "root_id", "t", (F.col("type") == "create_root").alias("births"), "parent_id", "operation_id")
    )
    removals = force.filter(F.col("type").isin("delete_root", "merge_roots")).select(
        "session_id", F.when(F.col("type") == "delete_root", F.col("root_id")).otherwise(F.col("source_id")).alias("root_id"), "t", F.when(F.col("type") == "merge_roots", F.col("root_id")).alias("into")
    ).filter(F.col("root_id").isNotNull() & ~F.col("root_id").eqNullSafe(F.col("into")))

    touched = force.filter(~F.col("type").isin("create_root", "reparent_root")).select("session_id", "root_id", "t", "operation_id")
    null = {"births": F.lit(None).cast("boolean"), "parent_id": none, "operation_id": none}
    rows = (
        writes.select("session_id", "root_id", "t", F.lit("w").alias("role"), "births", "parent_id", "operation_id")
        .unionByName(removals.select("session_id", "root_id", "t", F.lit("r").alias("role"), *(c.alias(n) for n, c in null.items())))
        .unionByName(touched.select("session_id", "root_id", "t", F.lit("o").alias("role"), null["births"].alias("births"), none.alias("parent_id"), "operation_id"))
    )
    last = rows.groupBy("session_id", "root_id").agg(
        F.max(F.when(F.col("births"), F.col("t"))).alias("born"),
        F.max(F.when(F.col("role") == "r", F.col("t"))).alias("gone"),
        F.max(F.when(F.col("role") == "w", F.struct("t", "parent_id"))).alias("link"),
        F.max(F.when(F.col("operation_id").isNotNull(), F.struct("t", "operation_id"))).alias("op"),
    )
    alive = last.filter("born is not null and (gone is null or born > gone)").select(
        "session_id", "root_id", F.col("link.parent_id").alias("at"), F.col("link.t").alias("t"), F.coalesce("op.operation_id", F.lit("")).alias("last_operation_id")
    )

    # Where a removal sends those that hang on the removed root: to the target of the merge, else to the root's last link before.
    both = writes.select("session_id", "root_id", "t", F.struct("t", "parent_id").alias("link"), none.alias("into"), F.lit(False).alias("removes")).unionByName(
        removals.select("session_id", "root_id", "t", F.lit(None).cast("struct<t:bigint,parent_id:string>").alias("link"), "into", F.lit(True).alias("removes"))
    )
    sent = running(both, ["session_id", "root_id"], ["t", "removes"], "link", "before", "last").filter("removes").select(
        "session_id", F.col("root_id").alias("gone_root"), F.col("t").alias("gone_t"),
        F.coalesce("into", "before.parent_id").alias("at"), F.when(F.col("into").isNotNull(), F.col("t")).otherwise(F.col("before.t")).alias("t"),
    )
    events = removals.select("session_id", F.col("root_id").alias("at"), F.col("t").alias("d"))
    hops = stored(_first_after(sent, events))
    hops = settle(hops)

    held = _first_after(stored(alive), events)
    ends = hops.select("session_id", F.col("gone_root").alias("at"), F.col("gone_t").alias("d"), F.col("at").alias("end"))
    out = held.join(ends, ["session_id", "at", "d"], "left")
    return out.select("session_id", "root_id", F.when(F.col("d").isNull(), F.col("at")).otherwise(F.col("end")).alias("parent_id"), "last_operation_id")


def settle(hops: DataFrame) -> DataFrame:
    """Follow removal after removal by pointer doubling, until every chain has come to a link that holds.

    A hop (gone_root, gone_t) leads to ``at``, and if ``d`` is not null to that root's removal at ``d``. The number of
    rounds is the logarithm of the longest chain of removals.
    """
    while not (open_ := hops.filter("d is not null")).isEmpty():
        nxt = hops.select("session_id", F.col("gone_root").alias("at"), F.col("gone_t").alias("d"), F.col("at").alias("at2"), F.col("d").alias("d2"))
        on = open_.join(nxt, ["session_id", "at", "d"], "left").select("session_id", "gone_root", "gone_t", F.col("at2").alias("at"), "t", F.col("d2").alias("d"))
        hops = stored(hops.filter("d is null").select(*on.columns).unionByName(on))
    return hops


def final_links(ops: DataFrame, label_map: DataFrame) -> DataFrame:
    """``replay`` without the top of each session (the root ``primary``)."""
    return replay(ops, label_map).filter(F.col("root_id") != "primary")
