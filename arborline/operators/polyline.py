"""Ordered polylines: nodes ``root_id, node_id, x, y, z`` as rows, one polyline per ``root_id`` (or per further ``by`` columns).

Windows go over one polyline each; nodes without coordinates are left out first. A polyline of fewer than two nodes has
length 0 and no direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.functions import geometry as g
from arborline.operators.spatial import segment_distances

BY = ["root_id"]

#: Consecutive segments that share a box in a search for the nearest one.
BOXED = 32


def usable(nodes: DataFrame) -> DataFrame:
    """Nodes with three finite coordinates."""
    ok = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in g.xyz()]
    return nodes.filter(ok[0] & ok[1] & ok[2])


def with_arc(nodes: DataFrame, by: list[str] = BY) -> DataFrame:
    """Adds ``step`` (length of the segment before a node, 0 at the first) and ``arc`` (length up to it)."""
    w = W.partitionBy(*by).orderBy("node_id")
    before = [F.lag(c).over(w) for c in g.xyz()]
    out = usable(nodes).withColumn("step", F.coalesce(g.norm(g.minus(g.xyz(), before)), F.lit(0.0)))
    return out.withColumn("arc", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def lengths(nodes: DataFrame, by: list[str] = BY) -> DataFrame:
    """Per polyline: nodes, length, chord (first to last node), tortuosity (length over chord, missing without a chord)."""
    ends = with_arc(nodes, by).groupBy(*by).agg(
        F.count("*").alias("nodes"), F.sum("step").alias("length"),
        F.min_by(F.struct("x", "y", "z"), "node_id").alias("a"), F.max_by(F.struct("x", "y", "z"), "node_id").alias("b"),
    )
    chord = g.norm(g.minus(g.xyz("b."), g.xyz("a.")))
    return ends.select(*by, "nodes", "length", chord.alias("chord"), g.ratio(F.col("length"), chord).alias("tortuosity"))


def tangents(nodes: DataFrame, by: list[str] = BY) -> DataFrame:
    """Unit direction at each node: forward and backward at the ends, central inside; +z where there is none."""
    w = W.partitionBy(*by).orderBy("node_id")
    ahead = [F.coalesce(F.lead(c).over(w), c) for c in g.xyz()]
    behind = [F.coalesce(F.lag(c).over(w), c) for c in g.xyz()]
    d = g.minus(ahead, behind)
    n = g.norm(d)
    unit = [F.when(n > g.TINY, c / F.when(n > g.TINY, n)).otherwise(F.lit(z)) for c, z in zip(d, (0.0, 0.0, 1.0))]
    return usable(nodes).select(*by, "node_id", *(u.alias(f"t{a}") for u, a in zip(unit, "xyz")))


def segments(nodes: DataFrame, by: list[str] = BY) -> DataFrame:
    """Consecutive pairs of nodes: seg_id (the first node), ax..az, bx..bz, arc (at the first node), length."""
    w = W.partitionBy(*by).orderBy("node_id")
    out = with_arc(nodes, by).select(*by, F.col("node_id").alias("seg_id"), *(F.col(a).alias(f"a{a}") for a in "xyz"), *(F.lead(a).over(w).alias(f"b{a}") for a in "xyz"), "arc", F.lead("step").over(w).alias("length"))
    return out.filter("length is not null")


def point_at(at: Column) -> list[Column]:
    """The point of a segment row (of ``segments``) at an arc position on it."""
    t = F.when(F.col("length") > 0, g.clamp((at - F.col("arc")) / F.when(F.col("length") > 0, F.col("length")), 0.0, 1.0)).otherwise(F.lit(0.0))
    return g.plus(g.xyz("a"), g.times(g.minus(g.xyz("b"), g.xyz("a")), t))


def resample(nodes: DataFrame, spacing: float, by: list[str] = BY) -> DataFrame:
    """Points at equal arc steps, both ends kept: number, arc, x, y, z.

    The step is ``spacing``, or a thousandth of the length if that is more (so that there are at most 1001 points). Each
    segment gives the points in its own half-open stretch, so nothing is joined.
    """
    s = segments(nodes, by)
    total = s.groupBy(*by).agg(F.sum("length").alias("total"), F.max("seg_id").alias("last_seg")).filter("total > 0")
    s = s.join(total, by).withColumn("step", F.greatest(F.lit(float(spacing)), F.col("total") / 1000))
    first = F.ceil(F.col("arc") / F.col("step") - 1e-9).cast("long")
    last = (F.ceil((F.col("arc") + F.col("length")) / F.col("step") - 1e-9) - 1).cast("long")
    at = F.col("number") * F.col("step")
    inner = s.withColumn("number", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    inner = inner.select(*by, "number", at.alias("arc_at"), *(c.alias(f"p{a}") for c, a in zip(point_at(at), "xyz")))
    end = s.filter("seg_id = last_seg").select(*by, F.ceil(F.col("total") / F.col("step") - 1e-9).cast("long").alias("number"), F.col("total").alias("arc_at"), *(F.col(f"b{a}").alias(f"p{a}") for a in "xyz"))
    return inner.unionByName(end).select(*by, "number", F.col("arc_at").alias("arc"), *(F.col(f"p{a}").alias(a) for a in "xyz"))


def project(points: DataFrame, nodes: DataFrame, by: list[str] = BY) -> DataFrame:
    """The nearest place on the own polyline of each point: point_id, arc, distance; ties go to the first segment.

    ``points``: by, point_id, x, y, z. A polyline's segments stand in boxes of BOXED consecutive ones. Points meet the
    boxes of their polyline, keep those that may hold the nearest segment (none whose nearest corner is farther than the
    farthest corner of another), and meet only the segments in these. Minima are taken of plain numbers, in hash aggregates.
    """
    w = W.partitionBy(*by).orderBy("seg_id")
    s = segments(nodes, by).withColumn("_box", F.floor((F.row_number().over(w) - 1) / BOXED).cast("long"))
    p = points.select(*by, "point_id", *(F.col(a).alias(f"p{a}") for a in "xyz"))
    boxes = s.groupBy(*by, "_box").agg(*(F.min(F.least(f"a{a}", f"b{a}")).alias(f"lo{a}") for a in "xyz"), *(F.max(F.greatest(f"a{a}", f"b{a}")).alias(f"hi{a}") for a in "xyz"))
    near = [F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"p{a}"), F.col(f"p{a}") - F.col(f"hi{a}")) for a in "xyz"]
    far = [F.greatest(F.abs(F.col(f"p{a}") - F.col(f"lo{a}")), F.abs(F.col(f"p{a}") - F.col(f"hi{a}"))) for a in "xyz"]
    met = p.join(boxes, by).select(*by, "point_id", "px", "py", "pz", "_box", g.dot(near, near).alias("_near"), g.dot(far, far).alias("_far"))
    bound = met.groupBy(*by, "point_id").agg(F.min("_far").alias("_bound"))
    kept = met.join(bound, [*by, "point_id"]).filter(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).drop("_near", "_far", "_bound")
    s = s.select(*by, "_box", "seg_id", "arc", "length", *(F.col(f"a{a}").alias(f"s{a}") for a in "xyz"), *((F.col(f"b{a}") - F.col(f"a{a}")).alias(f"u{a}") for a in "xyz"))
    pairs = segment_distances(kept.join(s, [*by, "_box"]), [*by, "point_id", "seg_id", "arc", "length"])
    least = pairs.groupBy(*by, "point_id").agg(F.min("square").alias("_least"))
    again = segment_distances(kept.join(least, [*by, "point_id"]).join(s, [*by, "_box"]), [*by, "point_id", "seg_id", "arc", "length", "_least"])
    best = again.filter(F.col("square") <= F.col("_least")).groupBy(*by, "point_id").agg(F.min(F.struct("seg_id", "square", "t", "arc", "length")).alias("m"))
    return best.select(*by, "point_id", (F.col("m.arc") + F.col("m.t") * F.col("m.length")).alias("arc"), F.sqrt("m.square").alias("distance"))


def arc_window(nodes: DataFrame, window: float, anchor: str = "end", by: list[str] = BY) -> DataFrame:
    """The direction of a stretch at the ``start`` or ``end``: the chord over min(window, a quarter of the length), wx, wy, wz."""
    s = segments(nodes, by)
    total = s.groupBy(*by).agg(F.sum("length").alias("total")).filter("total > 0")
    s = s.join(total, by)
    size = F.least(F.lit(float(window)), F.col("total") * 0.25)
    low, high = (F.lit(0.0), size) if anchor == "start" else (F.col("total") - size, F.col("total"))
    slack = 1e-9 * F.col("total")  # the sums of lengths may differ in their last digits
    inside = lambda at: (F.col("arc") <= at + slack) & (at <= F.col("arc") + F.col("length") + slack) & (F.col("length") > 0)
    held = s.select(*by, "seg_id", *(F.when(inside(low), c).alias(f"l{a}") for c, a in zip(point_at(low), "xyz")), *(F.when(inside(high), c).alias(f"h{a}") for c, a in zip(point_at(high), "xyz")))
    ends = held.groupBy(*by).agg(*(F.min_by(f"{e}{a}", F.when(F.col(f"{e}{a}").isNotNull(), F.col("seg_id"))).alias(f"{e}{a}") for e in "lh" for a in "xyz"))
    return ends.select(*by, *((F.col(f"h{a}") - F.col(f"l{a}")).alias(f"w{a}") for a in "xyz"))


def root_angles(nodes: DataFrame, window: float, parents: DataFrame | None = None, by: list[str] = BY) -> DataFrame:
    """Directional angles in degrees: by, emergence, base_gravity, tip_gravity.

    The direction at each end is that of ``arc_window``. Gravity is -z. ``parents``: by, px, py, pz, the parent's direction
    where the root leaves it; without it, or without a direction, emergence is missing.
    """
    a, b = arc_window(nodes, window, "start", by), arc_window(nodes, window, "end", by)
    out = a.select(*by, *(F.col(f"w{x}").alias(f"a{x}") for x in "xyz")).join(b.select(*by, *(F.col(f"w{x}").alias(f"b{x}") for x in "xyz")), by)
    out = out.join(parents.select(*by, "px", "py", "pz"), by, "left") if parents is not None else out.select("*", *(F.lit(None).cast("double").alias(f"p{x}") for x in "xyz"))
    down = [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    return out.select(*by, g.directed_angle(g.xyz("a"), g.xyz("p")).alias("emergence"), g.directed_angle(g.xyz("a"), down).alias("base_gravity"), g.directed_angle(g.xyz("b"), down).alias("tip_gravity"))


def frusta(nodes: DataFrame, radius: str = "radius", by: list[str] = BY) -> DataFrame:
    """Lateral area and volume as cone sections between nodes that both have a radius; missing if there is none."""
    w = W.partitionBy(*by).orderBy("node_id")
    s = usable(nodes).select(*by, F.col(radius).alias("r0"), F.lead(radius).over(w).alias("r1"), g.norm(g.minus([F.lead(c).over(w) for c in g.xyz()], g.xyz())).alias("h"))
    r0, r1, h = F.col("r0"), F.col("r1"), F.col("h")
    return s.groupBy(*by).agg(F.sum(g.frustum_area(r0, r1, h)).alias("lateral_area"), F.sum(g.frustum_volume(r0, r1, h)).alias("volume"))


def smooth(nodes: DataFrame, column: str, passes: int = 3, by: list[str] = BY) -> DataFrame:
    """Quarter, half, quarter smoothing of a column, again and again; the ends stay."""
    w = W.partitionBy(*by).orderBy("node_id")
    out = nodes
    for _ in range(passes):
        a, b = F.lag(column).over(w), F.lead(column).over(w)
        out = out.withColumn(column, F.coalesce(0.25 * a + 0.5 * F.col(column) + 0.25 * b, F.col(column)))
    return out


def fill_linear(nodes: DataFrame, column: str, position: str, by: list[str] = BY) -> DataFrame:
    """Missing values of a column filled linearly between the nearest present ones; beyond them the nearest holds."""
    w = W.partitionBy(*by).orderBy(position)
    here = F.when(F.col(column).isNotNull(), F.struct(F.col(position).alias("p"), F.col(column).alias("v")))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    down = W.partitionBy(*by).orderBy(F.desc(position))
    after = F.last(here, ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0))
    out = nodes.withColumn("_b", before).withColumn("_a", after)
    span = F.col("_a.p") - F.col("_b.p")
    between = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(position) - F.col("_b.p")) / F.when(span != 0, span)
    return out.withColumn(column, F.coalesce(column, between, F.col("_b.v"), F.col("_a.v"))).drop("_a", "_b")


def merge_intervals(spans: DataFrame, by: list[str] = BY, tolerance: float = 1e-10) -> DataFrame:
    """Overlapping or touching intervals ``low, high`` joined to covers."""
    w = W.partitionBy(*by).orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = (F.col("low") > reach + tolerance) | reach.isNull()
    marked = spans.filter("low is not null and high >= low").withColumn("_new", new.cast("int"))
    return marked.withColumn("cover", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*by, "cover").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("parts"))
