"""Parent-child links of unknown depth turned to hierarchies: depth, top, path, descendants, circles.

Leaves are peeled off until only circles are left; the links of the roots on circles are cut, which leaves a forest.
Its Euler tours (down and up each link) are ranked as linked lists, all in parallel; the entry and exit of a root in its
tour give its depth, its ancestors and its descendants (those whose entry lies between).

Samples of up to ``limit`` roots are laid side by side and ranked by a vectorised kernel, many in one Arrow batch, after
one shuffle. Larger ones are peeled and ranked by joins (pointer doubling), in which no task sees a whole sample. Both
ways give the same in all columns: siblings are toured in the order of their keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import newest, normal_key, partitions, stored

#: Roots of a sample that one task may hold.
LIMIT = 100_000

#: Children of one root are chained over so many windows, each over a range of keys.
FANS = 64

SCHEMA = "sample_id string, root_id string, parent_root_id string, root_order int, kind string, top_root_id string, depth long, entry long, exit long, descendants long"


def current_links(roots: DataFrame) -> DataFrame:
    """The newest row of each root: sample_id, root_id, key, parent_key, root_order.

    Keys are ids without case and outer blanks; a blank parent is none. Rows without a sample or an id are left out.
    """
    rows = roots.select("sample_id", "root_id", normal_key("root_id").alias("key"), "recorded_at", normal_key("parent_id").alias("parent_key"), F.col("root_order").cast("int").alias("root_order"))
    rows = rows.filter("sample_id is not null and key is not null")
    return newest(rows.select("sample_id", "key", "recorded_at", "root_id", "parent_key", "root_order"), ["sample_id", "key"], "recorded_at").select("sample_id", "key", "root_id", "parent_key", "root_order")


def peel(parent: np.ndarray) -> np.ndarray:
    """True for the nodes on circles: those left when leaves are peeled off again and again. -1 is no parent."""
    has = parent >= 0
    degree = np.bincount(parent[has], minlength=len(parent))
    left = np.ones(len(parent), bool)
    leaves = np.flatnonzero(degree == 0)
    while len(leaves):
        left[leaves] = False
        up = parent[leaves]
        up, n = np.unique(up[up >= 0], return_counts=True)
        degree[up] -= n
        leaves = up[(degree[up] == 0) & left[up]]
    return left


def euler_successors(parent: np.ndarray) -> np.ndarray:
    """The arc after each arc of the Euler tours; v is the way down to node v, n + v the way up; the last arc points to itself."""
    n = len(parent)
    order = np.lexsort((np.arange(n), parent))
    p = parent[order]
    new = np.r_[True, p[1:] != p[:-1]] if n else np.zeros(0, bool)
    inner = p >= 0
    first = np.full(n, -1)
    first[p[new & inner]] = order[new & inner]
    succ = np.empty(2 * n, np.int64)
    succ[:n] = np.where(first >= 0, first, n + np.arange(n))
    succ[n:] = np.where(parent >= 0, n + parent, n + np.arange(n))
    same = np.flatnonzero(~new & inner)  # has a sibling before it
    succ[n + order[same - 1]] = order[same]
    return succ


def rank_lists(succ: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parallel list ranking by pointer doubling: steps to the end, the weights from each item to the end (both included), the end."""
    at, steps = succ.copy(), (succ != np.arange(len(succ))).astype(np.int64)
    total = np.where(steps > 0, weight, 0)  # without the end's own weight
    while True:
        nxt = at[at]
        if np.array_equal(nxt, at):
            return steps, total + weight[at], at
        total, steps, at = total + total[at], steps + steps[at], nxt


def circle_tops(parent: np.ndarray, on: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For the nodes on circles, the node of least ``rank`` on the same circle (doubling of minima)."""
    best, at = np.arange(len(parent)), np.where(on, parent, np.arange(len(parent)))
    for _ in range(max(1, math.ceil(math.log2(max(2, int(on.sum())))))):
        other = best[at]
        best = np.where(rank[other] < rank[best], other, best)
        at = at[at]
    return best


def solve(frame: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """The kernel: the hierarchies of whole samples laid side by side (sample_id, key, root_id, parent_key, root_order)."""
    n = len(frame)
    frame = frame.sort_values(["sample_id", "key"], ignore_index=True)
    sample = pd.factorize(frame["sample_id"])[0].astype(np.int64)
    words = pd.factorize(pd.concat([frame["key"], frame["parent_key"]], ignore_index=True))[0].astype(np.int64)
    own, up = words[:n], words[n:]
    size = int(words.max()) + 1 if n else 1
    index = pd.Index(sample * size + own)
    parent = np.where(up >= 0, index.get_indexer(sample * size + up), -1)
    on = peel(parent)
    forest = np.where(on, -1, parent)
    succ = euler_successors(forest)
    weight = np.r_[np.ones(n, np.int64), -np.ones(n, np.int64)]
    steps, total, end = rank_lists(succ, weight)
    down, upward = np.arange(n), n + np.arange(n)
    tree = end[down] - n
    length = steps[tree] + 1
    ids = frame["root_id"].to_numpy(object)
    alphabet = np.empty(n, np.int64)
    alphabet[np.argsort(ids.astype(str), kind="stable")] = np.arange(n)
    tops = circle_tops(parent, on, alphabet)
    out = pd.DataFrame(
        {
            "sample_id": frame["sample_id"],
            "root_id": ids,
            "parent_root_id": np.where(parent >= 0, ids[parent], None) if n else ids,
            "root_order": frame["root_order"],
            "kind": np.where(on, "cycle", np.where(on[tree], "below_cycle", "tree")),
            "top_root_id": ids[np.where(on[tree], tops[tree], tree)],
            "depth": -total[down],
            "entry": length - 1 - steps[down],
            "exit": length - 1 - steps[upward],
        }
    )
    out["descendants"] = (out["exit"] - out["entry"] - 1) // 2
    if paths:
        found: list[list[str]] = [[] for _ in range(n)]
        for v in np.argsort(out["depth"].to_numpy(), kind="stable"):
            found[v] = [*found[forest[v]], ids[v]] if forest[v] >= 0 else [ids[v]]
        out["path"] = found
    return out


def _samples_in_batches(links: DataFrame, paths: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:  # sorted by sample: all but the last sample of what is held is whole
            held.append(batch)
            rows += len(batch)
            if rows >= LIMIT:
                frame = pd.concat(held)
                whole = frame["sample_id"] != frame["sample_id"].iloc[-1]
                if whole.any():
                    yield solve(frame[whole], paths)
                held = [frame[~whole]]
                rows = len(held[0])
        if rows:
            yield solve(pd.concat(held), paths)

    parts = links.repartition(partitions(links.sparkSession), "sample_id").sortWithinPartitions("sample_id")
    return parts.mapInPandas(run, SCHEMA + (", path array<string>" if paths else ""))


def _double(state: DataFrame, keys: list[str], carried: dict) -> DataFrame:
    """One round of pointer doubling: ``at`` of each open row becomes the ``at`` of that row's ``at``; ``carried`` joins the rest."""
    nxt = state.select("sample_id", F.col(keys[0]).alias("at"), F.col("at").alias("at2"), *(F.col(c).alias(c + "2") for c in carried))
    return state.join(nxt, ["sample_id", "at"], "left").select("sample_id", *keys, F.col("at2").alias("at"), *(e.alias(c) for c, e in carried.items()))


def _samples_by_joins(links: DataFrame, paths: bool) -> DataFrame:
    """The same by joins for samples of any size; all state has the key (sample, root), so that a large sample spreads."""
    up = links.select("sample_id", F.col("key").alias("parent_key"), F.col("key").alias("parent"), F.col("root_id").alias("parent_root_id"))
    nodes = stored(links.join(up, ["sample_id", "parent_key"], "left").select("sample_id", "key", "root_id", "parent", "parent_root_id", "root_order"))

    # Peel 2^k layers at a time: what 2^k links above some node is; when that set stays equal, it is the circles.
    state = stored(nodes.filter("parent is not null").select("sample_id", "key", F.col("parent").alias("at")))
    last = -1
    while True:
        image = state.select("sample_id", "at").distinct()
        count = image.count()
        if count in (0, last):
            break
        last = count
        state = stored(_double(state, ["key"], {}).filter("at is not null"))
    circle = stored(image.join(nodes.select("sample_id", F.col("key").alias("at"), F.col("root_id").alias("top"), "parent"), ["sample_id", "at"]).select("sample_id", F.col("at").alias("key"), F.col("parent").alias("at"), "top"))
    for _ in range(max(1, math.ceil(math.log2(max(2, count)))) if count else 0):
        circle = stored(_double(circle, ["key"], {"top": F.least("top", "top2")}))
    tops = circle.select("sample_id", "key", F.col("top").alias("circle_top"))
    cut_ = stored(nodes.join(tops, ["sample_id", "key"], "left").withColumn("forest", F.when(F.col("circle_top").isNull(), F.col("parent"))))

    # Euler tours. Siblings are ordered by key: windows within a range of keys (fan), then a window over the fans of one parent.
    kids = cut_.filter("forest is not null").select("sample_id", "forest", "key").repartitionByRange(FANS, "key")
    kids = stored(kids.withColumn("fan", F.spark_partition_id()))
    within = kids.withColumn("next", F.lead("key").over(W.partitionBy("sample_id", "forest", "fan").orderBy("key")))
    fans = kids.groupBy("sample_id", "forest", "fan").agg(F.min("key").alias("first"), F.max("key").alias("final"))
    fans = fans.withColumn("next_first", F.lead("first").over(W.partitionBy("sample_id", "forest").orderBy("fan")))
    heads = fans.groupBy("sample_id", "forest").agg(F.min_by("first", "fan").alias("child"))
    jumps = fans.select("sample_id", F.col("final").alias("key"), "next_first")
    d, u = (lambda c: F.struct(F.lit(0).alias("way"), F.col(c).alias("node"))), (lambda c: F.struct(F.lit(1).alias("way"), F.col(c).alias("node")))
    downs = cut_.select("sample_id", "key").join(heads.select("sample_id", F.col("forest").alias("key"), "child"), ["sample_id", "key"], "left")
    ups = cut_.select("sample_id", "key", "forest").join(within.select("sample_id", "key", "next"), ["sample_id", "key"], "left").join(jumps, ["sample_id", "key"], "left")
    ups = ups.withColumn("sibling", F.coalesce("next", "next_first"))
    arcs = downs.select("sample_id", d("key").alias("arc"), F.when(F.col("child").isNotNull(), d("child")).otherwise(u("key")).alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(1).cast("long").alias("total"), u("key").alias("end")).unionByName(
        ups.select("sample_id", u("key").alias("arc"), F.when(F.col("sibling").isNotNull(), d("sibling")).when(F.col("forest").isNotNull(), u("forest")).alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(-1).cast("long").alias("total"), u("key").alias("end"))
    )
    arcs = stored(arcs)
    while not (open_ := arcs.filter("at is not null")).isEmpty():
        nxt = arcs.select("sample_id", F.col("arc").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("s2"), F.col("total").alias("t2"), F.col("end").alias("e2"))
        on = open_.join(nxt, ["sample_id", "at"]).select("sample_id", "arc", F.col("at2").alias("at"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("total") + F.col("t2")).alias("total"), F.col("e2").alias("end"))
        arcs = stored(arcs.filter("at is null").select(*on.columns).unionByName(on))
    way = F.col("arc.way")
    spans = arcs.groupBy("sample_id", F.col("arc.node").alias("key")).agg(
        F.max(F.when(way == 0, F.col("steps"))).alias("from_end"), F.max(F.when(way == 1, F.col("steps"))).alias("up_from_end"),
        F.max(F.when(way == 0, -F.col("total"))).alias("depth"), F.max(F.when(way == 0, F.col("end.node"))).alias("tree"),
    )
    trees = spans.filter("key = tree").select("sample_id", "tree", F.col("from_end").alias("length"))
    trees = trees.join(cut_.select("sample_id", F.col("key").alias("tree"), F.col("root_id").alias("tree_root_id"), "circle_top"), ["sample_id", "tree"])
    out = spans.join(trees, ["sample_id", "tree"]).join(cut_.drop("circle_top"), ["sample_id", "key"])
    kind = F.when(F.col("circle_top").isNull(), "tree").when(F.col("key") == F.col("tree"), "cycle").otherwise("below_cycle")
    out = out.select(
        "sample_id", "key", "root_id", "parent_root_id", "root_order", kind.alias("kind"), F.coalesce("circle_top", "tree_root_id").alias("top_root_id"), "depth",
        (F.col("length") - F.col("from_end")).alias("entry"), (F.col("length") - F.col("up_from_end")).alias("exit"),
    ).withColumn("descendants", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long"))
    if paths:
        lines = stored(cut_.select("sample_id", "key", F.col("forest").alias("at"), F.array("root_id").alias("path")))
        while not (open_ := lines.filter("at is not null")).isEmpty():
            nxt = lines.select("sample_id", F.col("key").alias("at"), F.col("at").alias("at2"), F.col("path").alias("p2"))
            on = open_.join(nxt, ["sample_id", "at"]).select("sample_id", "key", F.col("at2").alias("at"), F.concat("p2", "path").alias("path"))
            lines = stored(lines.filter("at is null").select(*on.columns).unionByName(on))
        out = out.join(lines.select("sample_id", "key", "path"), ["sample_id", "key"])
    return out.drop("key")


def hierarchies(roots: DataFrame, paths: bool = False, limit: int = LIMIT) -> DataFrame:
    """One row per root: its parent, top, depth, the interval of its Euler tour and the number of its descendants.

    ``kind``: tree, cycle (on a circle) or below_cycle. Of a root on a circle, top is the alphabetically first root on
    it and depth 0; below one, depth counts the links to the first root on it; else top is the end of the chain. ``w`` is
    a descendant of ``v`` if they have the same sample and tree and v.entry < w.entry < v.exit (below and on circles the
    tree hangs on the first root on the circle). With ``paths``, ``path`` holds the ids from the end of the chain down to the
    root. Older rows of a root and exact repeats do not count; an empty table gives an empty one.
    """
    links = current_links(roots)
    sizes = roots.groupBy("sample_id").count().filter(F.col("count") > limit)
    if sizes.isEmpty():
        return _samples_in_batches(links, paths)
    links, big = stored(links), stored(sizes.select("sample_id"))
    small = links.join(big, "sample_id", "left_anti")
    return _samples_in_batches(small, paths).unionByName(_samples_by_joins(links.join(big, "sample_id", "left_semi"), paths))


def hierarchy_faults(roots: DataFrame, top: str = "primary", limit: int = LIMIT) -> DataFrame:
    """``sample_id, root_id, finding, top_root_id, depth`` of the roots that do not hang on ``top`` at their recorded order.

    ``finding``: cycle, below_cycle, detached (the chain ends elsewhere), order (root_order is not the number of links).
    """
    h = hierarchies(roots, limit=limit)
    finding = (
        F.when(F.col("kind") != "tree", F.col("kind"))
        .when(normal_key("top_root_id") != top, "detached")
        .when(F.col("root_order").isNotNull() & (F.col("root_order") != F.col("depth")), "order")
    )
    return h.select("sample_id", "root_id", finding.alias("finding"), "top_root_id", "depth").filter("finding is not null")
