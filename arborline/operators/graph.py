"""Connected components of edge tables by alternating star contraction, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arborline.common import stored

#: Nodes that a task contracts at a time.
PIECE = 2_000_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges replaced by stars around the least node of what they connect (union-find over its own edges, in pieces of bounded size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars() -> pd.DataFrame:
            rows = [(x, t) for x in up if (t := top(x)) != x]
            up.clear()
            return pd.DataFrame(rows, columns=["u", "v"])

        for batch in batches:
            for u, v in zip(batch["u"], batch["v"]):
                a, b = top(up.setdefault(u, u) if u not in up else u), top(up.setdefault(v, v) if v not in up else v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > PIECE:
                yield stars()
        yield stars()

    return edges.mapInPandas(run, edges.schema)


def _observed(df: DataFrame) -> tuple[DataFrame, tuple]:
    """``df`` written, with its number of rows and the sum of their hashes, taken while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, component``: the smallest id that each node is connected with.

    ``edges``: u, v. Large-star and small-star steps (Kiveris et al. 2014) alternate until nothing changes, some log n
    rounds, after each task has contracted its own edges. Neighbour minima are plain aggregates, so a node with very many edges is combined on the map side. ``nodes``
    (id) adds those without an edge. Self-loops and repeated edges change nothing.
    """
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ends = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id")))
    every = (ends if nodes is None else ends.union(nodes.select("id"))).filter("id is not null").distinct()
    e, last = _observed(_contracted(e))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e, state = _observed(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if state == last:
            break
        last = state
    return every.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
