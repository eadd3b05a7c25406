"""Neighbourhood joins on points by a grid: equal-join on cells, then the exact distance.

Points are ``{id}, x, y, z`` with optional ``by`` columns (a sample). A cell is as wide as the search radius, so that all
partners stand in the 27 cells around; only the smaller side is copied into them. Both sides of the join are hash
partitioned by cell by the join itself, so that AQE splits the parts with crowded cells; a search for the nearest starts
with a radius at which no cell is crowded. Points without coordinates have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import stored
from arborline.functions import geometry as g


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def _cells(points: DataFrame, width: float, around: bool) -> DataFrame:
    out = points
    for a in "xyz":
        c = _cell(F.col(a), width)
        out = out.withColumn(f"_c{a}", F.explode(F.array(c - 1, c, c + 1)) if around else c)
    return out


def within(left: DataFrame, right: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of ``left`` (a_id, x, y, z) and ``right`` (b_id, x, y, z) at most ``radius`` apart: a_id, b_id, distance."""
    by = by or []
    a = _cells(left, radius, False).select(*by, "a_id", *(F.col(c).alias(f"a{c}") for c in "xyz"), "_cx", "_cy", "_cz")
    b = _cells(right, radius, True).select(*by, "b_id", *(F.col(c).alias(f"b{c}") for c in "xyz"), "_cx", "_cy", "_cz")
    d = g.norm(g.minus(g.xyz("a"), g.xyz("b")))
    return a.join(b, [*by, "_cx", "_cy", "_cz"]).withColumn("distance", d).filter(F.col("distance") <= radius).select(*by, "a_id", "b_id", "distance")


def radius_counts(points: DataFrame, radius: float) -> DataFrame:
    """``id, neighbours``: the other points within the radius, 0 included."""
    pairs = within(points.withColumnRenamed("id", "a_id"), points.withColumnRenamed("id", "b_id"), radius).filter("a_id <> b_id")
    n = pairs.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("neighbours"))
    return points.select("id").join(n, "id", "left").select("id", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))


#: Different places in one cell, as a multiple of k, from which on a search starts with a smaller radius.
CROWD = 50


def start_radius(points: DataFrame, k: int) -> tuple[float, float]:
    """A radius that holds some 2k points if they were spread evenly, less if cells of its width were crowded, and the diagonal of all points."""
    r = points.agg(F.count("*").alias("n"), *(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if not r["n"] or r["lox"] is None:
        return 1.0, 1.0
    sides = [r[f"hi{a}"] - r[f"lo{a}"] for a in "xyz"]
    diagonal = max(sum(s * s for s in sides) ** 0.5, 1e-9)
    volume = max(1e-300, sides[0] * sides[1] * sides[2])
    radius = min(diagonal, max((2 * k * volume / (4.19 * r["n"])) ** (1 / 3), diagonal * 1e-4))
    places = points.select("x", "y", "z").distinct() if r["n"] > CROWD * k else None
    while places is not None and radius > diagonal * 1e-9:
        most = places.groupBy(*(_cell(F.col(a), radius) for a in "xyz")).count().agg(F.max("count")).first()[0] or 0
        if most <= CROWD * k:
            break
        radius /= 2
    return radius, diagonal


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float | None = None, same: bool = False) -> DataFrame:
    """The ``k`` nearest of ``right`` for each of ``left``, exact: a_id, b_id, distance, rank (ties by b_id).

    A point that has k partners within the radius is done, since none nearer can lie outside; the radius is doubled for
    the rest until it spans everything. ``same``: the two are one table and a point is not its own partner. Of points
    of ``right`` at one place only the k (and one) of least id can be partners, so that others are left out at first.
    """
    start, diagonal = start_radius(left.select("x", "y", "z").unionByName(right.select("x", "y", "z")), k)
    radius = radius or start
    at = W.partitionBy("x", "y", "z").orderBy("b_id")
    right = stored(right.select("b_id", "x", "y", "z").withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= k + int(same)).drop("_n"))
    todo, done = left, None
    while True:
        whole = radius > diagonal
        pairs = within(todo, right, radius)
        if same:
            pairs = pairs.filter("a_id <> b_id")
        w = W.partitionBy("a_id").orderBy("distance", "b_id")
        top = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if whole:
            return top if done is None else done.unionByName(top)
        top = stored(top)
        full = top.filter(F.col("rank") == k).select("a_id")
        part = top.join(full, "a_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = stored(todo.join(full, "a_id", "left_anti"))
        if todo.isEmpty():
            return done
        radius *= 2


def knn(points: DataFrame, k: int) -> DataFrame:
    """The k nearest other points of each point."""
    return nearest(points.withColumnRenamed("id", "a_id"), points.withColumnRenamed("id", "b_id"), k, same=True)


def knn_graph(points: DataFrame, k: int) -> DataFrame:
    """The undirected graph of all k-nearest pairs: u < v, distance."""
    e = knn(points, k).select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), "distance")
    return e.groupBy("u", "v").agg(F.max("distance").alias("distance"))


def mean_nearest_distance(points: DataFrame) -> DataFrame:
    """One row: the average distance to the nearest other record (a record at the same place counts 0)."""
    return knn(points, 1).agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("points"))


def mutual_contacts(points: DataFrame, k: int, spread: float = 2.5) -> DataFrame:
    """Pairs u < v with different labels that are among each other's k nearest and within ``spread`` local spacings at both ends.

    ``points``: id, x, y, z, label. The local spacing of a point is the distance to its nearest other point.
    """
    e = stored(knn(points, k))
    spacing = e.filter("rank = 1").select(F.col("a_id").alias("id"), F.col("distance").alias("spacing"))
    back = e.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id"))
    both = e.join(back, ["a_id", "b_id"], "left_semi").filter("a_id < b_id")
    facts = points.select("id", "label").join(spacing, "id")
    out = both.join(facts.select(F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("spacing").alias("a_spacing")), "a_id")
    out = out.join(facts.select(F.col("id").alias("b_id"), F.col("label").alias("b_label"), F.col("spacing").alias("b_spacing")), "b_id")
    keep = (F.col("a_label") != F.col("b_label")) & (F.col("distance") <= spread * F.least("a_spacing", "b_spacing"))
    return out.filter(keep).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), "distance", F.col("a_label").alias("u_label"), F.col("b_label").alias("v_label"))


def segment_distances(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Squared distance of points ``p`` from segments that start at ``s`` and run along ``u``, and the share ``t`` of u at the nearest place.

    In steps whose columns are used more than once, so that the generated code stays small enough to be compiled.
    """
    ap, u = g.minus(g.xyz("p"), g.xyz("s")), g.xyz("u")
    one = pairs.select(*keep, g.dot(ap, u).alias("_q"), g.dot(u, u).alias("_l"), g.dot(ap, ap).alias("_a"))
    two = one.withColumn("t", F.when(F.col("_l") > 0, g.clamp(F.col("_q") / F.when(F.col("_l") > 0, F.col("_l")), 0.0, 1.0)).otherwise(F.lit(0.0)))
    square = F.col("_a") - 2 * F.col("t") * F.col("_q") + F.col("t") * F.col("t") * F.col("_l")
    return two.select(*keep, "t", F.greatest(F.lit(0.0), square).alias("square"))


def nearest_two_owners(points: DataFrame, pieces: DataFrame, radius: float) -> DataFrame:
    """The nearest and the second nearest owner of each point by the distance to their segments, within the radius.

    ``points``: id, x, y, z. ``pieces``: owner, seg_id, ax..bz. Segments are cut so short that their middle leads to them:
    a piece of length at most ``radius`` has all its points within half a radius of its middle, so that cells of one and a
    half radii hold every pair. Ties in distance go to the smaller owner. Points without an owner in reach are left out.
    """
    length = g.norm(g.minus(g.xyz("b"), g.xyz("a")))
    n = F.greatest(F.lit(1), F.ceil(length / radius)).cast("int")
    cut_ = pieces.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda k: g.plus(g.xyz("a"), g.times(g.minus(g.xyz("b"), g.xyz("a")), k / F.col("_n")))
    p0, p1 = at(F.col("_k")), at(F.col("_k") + 1)
    short = cut_.select("owner", *(c.alias(f"s{a}") for c, a in zip(p0, "xyz")), *(c.alias(f"e{a}") for c, a in zip(p1, "xyz")))
    short = short.select("*", *(((F.col(f"s{a}") + F.col(f"e{a}")) / 2).alias(a) for a in "xyz"))
    reach = 1.5 * radius
    left = _cells(points, reach, False).select("id", *(F.col(a).alias(f"p{a}") for a in "xyz"), "_cx", "_cy", "_cz")
    right = _cells(short, reach, True).drop("x", "y", "z")
    right = right.withColumns({f"u{a}": F.col(f"e{a}") - F.col(f"s{a}") for a in "xyz"}).drop("ex", "ey", "ez")
    pairs = segment_distances(left.join(right, ["_cx", "_cy", "_cz"]), ["id", "owner"])
    # The limit comes after the minimum: put before it, the planner would move it into the join and compute it there again.
    best = pairs.groupBy("id", "owner").agg(F.min("square").alias("square")).filter(F.col("square") <= radius * radius).select("id", "owner", F.sqrt("square").alias("distance"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("distance", "owner"))).filter("rank <= 2")
    return ranked.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("owner"))).alias("owner"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("distance"),
        F.max(F.when(F.col("rank") == 2, F.col("owner"))).alias("rival"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("rival_distance"),
    )


def assign(competition: DataFrame, margin: float) -> DataFrame:
    """Adds ``label`` to ``nearest_two_owners``: the owner, or -2 (uncertain) where the rival is within the margin."""
    close = F.col("rival_distance").isNotNull() & (F.col("rival_distance") - F.col("distance") <= margin)
    return competition.withColumn("label", F.when(close, F.lit(-2)).otherwise(F.col("owner")).cast("int"))


def unit_box(points: DataFrame) -> DataFrame:
    """Coordinates moved to the minimum corner and divided by the greatest extent (one-row frame, broadcast); missing if that is 0."""
    frame = points.agg(*(F.min(a).alias(f"lo{a}") for a in "xyz"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("extent"))
    size = F.when(F.col("extent") > 0, F.col("extent"))
    return points.crossJoin(F.broadcast(frame)).select("id", *(((F.col(a) - F.col(f"lo{a}")) / size).alias(a) for a in "xyz"))


def above_base(points: DataFrame, base: tuple[float, float, float], tipward: tuple[float, float, float], near: float, tolerance: float = 0.0) -> DataFrame:
    """Whether each point lies above the base: against ``tipward`` within ``near`` of it, else against gravity (down is -z)."""
    rel = [F.col(a) - F.lit(float(b)) for a, b in zip("xyz", base)]
    local, down = g.dot(rel, [F.lit(float(v)) for v in tipward]), -rel[2]
    return points.select("id", F.when(g.norm(rel) <= near, local < -tolerance).otherwise(down < -tolerance).alias("above"))


def depth_histogram(points: DataFrame, bins: int = 10) -> DataFrame:
    """Points per tenth of the depth below the highest point; empty bins are there with 0."""
    span = points.agg(F.max("z").alias("top"), (F.max("z") - F.min("z")).alias("depth"))
    share = F.when(F.col("depth") > 0, (F.col("top") - F.col("z")) / F.when(F.col("depth") > 0, F.col("depth"))).otherwise(F.lit(0.0))
    held = points.crossJoin(F.broadcast(span)).select(F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(held, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("points"))


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def principal_variances(points: DataFrame, by: list[str]) -> DataFrame:
    """The variances along the principal axes of each group, from great to small: first, second, third.

    Covariances are aggregated with a map-side combine, so that a group of any size comes as six numbers.
    """
    pairs = ("xx", "yy", "zz", "xy", "yz", "xz")
    c = points.groupBy(*by).agg(*(F.covar_pop(p[0], p[1]).alias(f"_{p}") for p in pairs)).na.drop(subset=[f"_{p}" for p in pairs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.empty((len(batch), 3, 3))
            for p in pairs:
                i, j = "xyz".index(p[0]), "xyz".index(p[1])
                m[:, i, j] = m[:, j, i] = batch[f"_{p}"]
            w = np.linalg.eigvalsh(m)[:, ::-1]
            yield batch[by].assign(first=w[:, 0], second=w[:, 1], third=w[:, 2])

    return c.mapInPandas(run, f"{_kinds(points, by)}, first double, second double, third double")


def envelope(points: DataFrame, by: list[str]) -> DataFrame:
    """Depth (along z), the greatest horizontal width, and depth to width of each group.

    The width is that of the convex hull: each task reduces its points of a group to the corners of their hull, the
    corners of all tasks are put together.
    """
    from arborline.operators.kernels import hull_2d, hull_width

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, own in batch.groupby(by, dropna=False):
                p = own[["x", "y"]].to_numpy()
                held[key] = hull_2d(np.concatenate([held[key], p]) if key in held else p)
        rows = [(*k, float(x), float(y)) for k, h in held.items() for x, y in h]
        yield pd.DataFrame(rows, columns=[*by, "x", "y"])

    def width(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, hull_width(pdf[["x", "y"]].to_numpy()))], columns=[*by, "width"])

    p = points.filter("x is not null and y is not null and z is not null")
    flat = p.select(*by, "x", "y").mapInPandas(corners, f"{_kinds(points, by)}, x double, y double")
    wide = flat.groupBy(*by).applyInPandas(width, f"{_kinds(points, by)}, width double")
    depth = p.groupBy(*by).agg((F.max("z") - F.min("z")).alias("depth"))
    return depth.join(wide, by).select(*by, "depth", "width", g.ratio(F.col("depth"), F.col("width")).alias("depth_to_width"))


def landmarks(points: DataFrame, by: list[str], count: int) -> DataFrame:
    """``count`` spread-out points of each group: the lowest, then always the one farthest from those chosen (ties: the smallest id): by, place, id.

    One aggregation over all points for each place, so that a group of any size is spread over all tasks; points at places
    already chosen are no more chosen.
    """
    left = stored(points.filter("x is not null and y is not null and z is not null").select(*by, "id", "x", "y", "z", F.lit(float("inf")).alias("_gap")))
    at = F.struct("id", "x", "y", "z")
    new = stored(left.groupBy(*by).agg(F.min_by(at, F.struct("z", "id")).alias("m")).select(*by, F.lit(0).cast("long").alias("place"), "m.*"))
    out = new.select(*by, "place", "id")
    for place in range(1, count):
        last = new.select(*by, *(F.col(a).alias(f"c{a}") for a in "xyz"))
        square = g.minus(g.xyz(), g.xyz("c"))
        left = stored(left.join(last, by).withColumn("_gap", F.least("_gap", F.sqrt(g.dot(square, square)))).filter("_gap > 0").drop("cx", "cy", "cz"))
        new = stored(left.groupBy(*by).agg(F.max_by(at, F.struct("_gap", -F.col("id"))).alias("m")).select(*by, F.lit(place).cast("long").alias("place"), "m.*"))
        out = out.unionByName(new.select(*by, "place", "id"))
    return out
