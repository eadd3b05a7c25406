"""Ordered scans over long histories, without bringing one history into one task.

Rows are range partitioned by (key, order), so a key with a third of all rows spreads over a third of the partitions.
A first pass gives a small summary of the key that runs on beyond the end of each partition; the summaries (one per
partition) are composed on the driver, and a second pass goes over each partition with the state that comes into it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from arborline.common import cut, partitions


def range_blocks(df: DataFrame, key: str, order: list[str], n: int | None = None) -> DataFrame:
    """``df`` range partitioned and sorted by (key, order) and written to the checkpoint folder.

    The written form makes both passes see the same partitions even after the loss of an executor.
    """
    n = n or partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order))


def rows_by_key(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[Any, Iterator[dict]]]:
    """The rows of a sorted partition as (key, rows), batch by batch: no key is held as a whole."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_dict("records")

    stream = rows()
    head = next(stream, None)
    while head is not None:
        current = head[key]

        def own() -> Iterator[dict]:
            nonlocal head
            while head is not None and head[key] == current:
                row = head
                head = next(stream, None)
                yield row

        group = own()
        yield current, group
        for _ in group:
            pass


def scan_blocks(
    blocks: DataFrame,
    key: str,
    summarise: Callable[[Iterator[dict]], bytes],
    combine: Callable[[bytes | None, bytes], bytes],
    emit: Callable[[Any, Iterator[dict], bytes | None], Iterator[dict]],
    schema: str,
) -> DataFrame:
    """A left-to-right scan per key.

    ``summarise`` gives the summary of consecutive rows of one key, ``combine`` joins the state before with a
    summary, ``emit`` makes output rows from a key's rows in a partition and the state that comes into it (None at the
    first row of a key). The driver gets one summary per partition, of its last key.
    """

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The summary of the partition's last key; only the last key of a batch can be that, so other rows are passed over."""
        first, last, state = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key]
            first = keys.iloc[0] if last is None else first
            if keys.iloc[-1] != last:
                last, state = keys.iloc[-1], None
            state = combine(state, summarise(iter(batch[keys == last].to_dict("records"))))
        if last is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "one": [first == last], "k": [last], "s": [state]})

    kind = blocks.schema[key].dataType.simpleString()
    tails = sorted(blocks.mapInPandas(tail, f"part int, one boolean, k {kind}, s binary").collect(), key=lambda r: r["part"])
    coming: dict[int, tuple[Any, bytes]] = {}
    state: tuple[Any, bytes] | None = None
    for r in tails:
        if state is not None:
            coming[r["part"]] = state
        before = state[1] if state is not None and state[0] == r["k"] and r["one"] else None
        state = (r["k"], combine(before, bytes(r["s"])))
    handed = blocks.sparkSession.sparkContext.broadcast(coming)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into = handed.value.get(TaskContext.get().partitionId())
        out: list[dict] = []
        for k, rows in rows_by_key(batches, key):
            for row in emit(k, rows, into[1] if into is not None and into[0] == k else None):
                out.append(row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out)
                    out = []
        if out:
            yield pd.DataFrame(out)

    return blocks.mapInPandas(run, schema)
