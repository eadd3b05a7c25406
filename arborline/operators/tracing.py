"""The set-oriented parts of tracing: samples of points, seeds, rejection of copies, masks, stations, and the trait table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.common import finite
from arborline.functions import geometry as g
from arborline.operators import ownership, polyline, spatial


def analysis_sample(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A seeded share of the points, and the extreme ones along each axis: id, x, y, z.

    A point is drawn by the hash of its id, so the sample is the same on any cluster and a larger share holds the smaller.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") / float(1 << 53)
    ends = points.agg(*(f("id", F.struct(a, "id")).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min_by), ("hi", F.max_by))))
    ids = ends.select(F.explode(F.array(*ends.columns)).alias("id"))
    drawn = points.filter(u < share)
    return drawn.unionByName(points.join(F.broadcast(ids.distinct()), "id", "left_semi").select(*points.columns)).distinct()  # six ids


def analysis_target(points: int, seconds: float, per_thousand: float, least_share: float, keep_below: int = 25_000) -> float:
    """The share of points that a time allows, at a measured cost per thousand, but at least ``least_share``; few points are all kept."""
    return 1.0 if points <= keep_below else min(1.0, max(least_share, seconds / max(per_thousand * points / 1000, 1e-12)))


def seed_limits(radii: DataFrame, spacing: float, by: list[str]) -> DataFrame:
    """How far from each node of a parent seeds may lie: by, node_id, near. ``radii``: by, node_id, radius.

    max(14 spacings, 0.012), the radius plus nine spacings, and twice the radius plus two where the parent is slender.
    """
    p99 = F.percentile("radius", 0.99).over(W.partitionBy(*by))
    slender = (F.col("radius") <= 16 * spacing) & (p99 <= 18 * spacing)
    return radii.select(*by, "node_id", F.greatest(F.lit(max(14 * spacing, 0.012)), F.col("radius") + 9 * spacing, F.when(slender, 2 * F.col("radius") + 2 * spacing)).alias("near"))


def tube_mask(points: DataFrame, nodes: DataFrame, spacing: float) -> DataFrame:
    """Whether each point lies in the tube of an ancestor: id, inside. ``nodes``: node_id, x, y, z, radius.

    The nearest node decides: the distance is at most its radius plus two spacings.
    """
    near = spatial.nearest(points.select(F.col("id").alias("a_id"), "x", "y", "z"), nodes.select(F.col("node_id").alias("b_id"), "x", "y", "z"), 1)
    m = near.join(nodes.select(F.col("node_id").alias("b_id"), "radius"), "b_id")
    return m.select(F.col("a_id").alias("id"), (F.col("distance") <= F.col("radius") + 2 * spacing).alias("inside"))


def tracking_copies(candidates: DataFrame, parents: DataFrame, spacing: float, share: float = 0.8) -> DataFrame:
    """Candidates that only follow an existing path: candidate_id, share_within, mean_alignment, copy.

    ``candidates`` and ``parents``: (candidate_id or node_id), node_id, x, y, z, tx, ty, tz. A copy has ``share`` of its
    nodes within 12 spacings of the parents and an axial angle of at most 30 degrees to them on average.
    """
    c = candidates.withColumn("a_id", F.struct("candidate_id", "node_id"))
    near = spatial.within(c.select("a_id", "x", "y", "z"), parents.select(F.col("node_id").alias("b_id"), "x", "y", "z"), 12 * spacing)
    best = near.groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).alias("m")).select("a_id", F.col("m.b_id").alias("b_id"))
    p = parents.select(F.col("node_id").alias("b_id"), *(F.col(f"t{a}").alias(f"p{a}") for a in "xyz"))
    j = c.join(best, "a_id", "left").join(p, "b_id", "left")
    angle = g.axial_angle([F.col(f"t{a}") for a in "xyz"], [F.col(f"p{a}") for a in "xyz"])
    s = j.groupBy("candidate_id").agg((F.count("b_id") / F.count("*")).alias("share_within"), F.avg(angle).alias("mean_alignment"))
    return s.withColumn("copy", (F.col("share_within") >= share) & F.coalesce(F.col("mean_alignment") <= 30, F.lit(False)))


def station_slabs(points: DataFrame, stations: DataFrame, radius: float, half: float) -> DataFrame:
    """The points in a thin slab across each station: station, id, axial, u, v (in the slab's plane).

    ``stations``: station, x, y, z, tx, ty, tz (unit). The plane's axes are the one nearest across the tangent and its cross.
    """
    near = spatial.within(stations.select(F.col("station").alias("a_id"), "x", "y", "z"), points.select(F.col("id").alias("b_id"), "x", "y", "z"), radius)
    j = near.select(F.col("a_id").alias("station"), F.col("b_id").alias("id")).join(stations.select("station", *(F.col(a).alias(f"s{a}") for a in "xyz"), *(f"t{a}" for a in "xyz")), "station").join(points.select("id", "x", "y", "z"), "id")
    t = [F.col(f"t{a}") for a in "xyz"]
    rel = g.minus(g.xyz(), g.xyz("s"))
    axial = g.dot(rel, t)
    steep = F.abs(t[2]) < 0.9
    helper = [F.when(steep, F.lit(0.0)).otherwise(F.lit(1.0)), F.lit(0.0), F.when(steep, F.lit(1.0)).otherwise(F.lit(0.0))]
    raw = g.cross(t, helper)
    e1 = [c / g.norm(raw) for c in raw]
    return j.select("station", "id", axial.alias("axial"), g.dot(rel, e1).alias("u"), g.dot(rel, g.cross(t, e1)).alias("v")).filter(F.abs("axial") <= half)


def recenter(stations: DataFrame, slabs: DataFrame, least: int = 8) -> DataFrame:
    """Stations moved to the middle of their slabs (medians across), where enough points are; then smoothed along: station, x, y, z."""
    m = slabs.groupBy("station").agg(F.count("*").alias("n"), F.percentile("u", 0.5).alias("mu"), F.percentile("v", 0.5).alias("mv"))
    j = stations.join(m, "station", "left")
    t = [F.col(f"t{a}") for a in "xyz"]
    steep = F.abs(t[2]) < 0.9
    helper = [F.when(steep, F.lit(0.0)).otherwise(F.lit(1.0)), F.lit(0.0), F.when(steep, F.lit(1.0)).otherwise(F.lit(0.0))]
    raw = g.cross(t, helper)
    e1 = [c / g.norm(raw) for c in raw]
    e2 = g.cross(t, e1)
    ok = F.col("n") >= least
    moved = [F.when(ok, c + F.col("mu") * p + F.col("mv") * q).otherwise(c) for c, p, q in zip(g.xyz(), e1, e2)]
    out = j.select(F.lit(1).alias("root_id"), F.col("station").alias("node_id"), *(c.alias(a) for c, a in zip(moved, "xyz")))
    for a in "xyz":
        out = polyline.smooth(out, a)
    return out.select(F.col("node_id").alias("station"), "x", "y", "z")


def medoids(variants: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Variants of one start reduced to one per place of their ends: by, variant_id, members.

    ``variants``: by, variant_id, x, y, z (end), score. Ends are put in cells of the reach; a cell keeps its best variant.
    """
    cell = [F.floor(F.col(a) / reach).alias(f"_{a}") for a in "xyz"]
    return variants.groupBy(*by, *cell).agg(F.max_by("variant_id", F.struct("score", "variant_id")).alias("variant_id"), F.count("*").alias("members")).select(*by, "variant_id", "members")


def skeleton_regions(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with the part of the root they belong to: parent_connector before the body, retained_prior and preserved_topology by flag, else exposed_body."""
    flags = F.coalesce(F.col("qc_flags"), F.array().cast("array<string>"))
    region = F.when(F.col("node_id") < F.col("body_start_index"), "parent_connector").when(F.array_contains(flags, "retained_prior"), "retained_prior").when(F.array_contains(flags, "preserved_topology"), "preserved_topology").otherwise("exposed_body")
    return nodes.join(roots.select("sample_id", "root_id", "body_start_index", "qc_flags"), ["sample_id", "root_id"]).select("sample_id", "root_id", "node_id", "x", "y", "z", region.alias("region"))


def root_traits(nodes: DataFrame, roots: DataFrame, supported: DataFrame, mm_per_unit: Column | float = 1.0) -> DataFrame:
    """The per-root table: length, chord, tortuosity, mean radius, volume and area in mm, with state and reason of the length.

    ``nodes``: root_id, node_id, x, y, z, radius; ``roots``: root_id, root_order, excluded; ``supported``: root_id, share of
    the centreline that has measured support (null: none). Lengths scale with the unit, areas with its square, volumes with
    its cube. A root without nodes is there with missing values.
    """
    k = F.lit(mm_per_unit) if not isinstance(mm_per_unit, Column) else mm_per_unit
    l = polyline.lengths(nodes)
    f = polyline.frusta(nodes)
    w = ownership.arc_weighted_radius(polyline.with_arc(nodes).select("root_id", "arc", "radius"), ["root_id"]).withColumnRenamed("radius", "mean_radius")
    t = roots.join(l, "root_id", "left").join(f, "root_id", "left").join(w, "root_id", "left").join(supported, "root_id", "left")
    length = finite("length") * k
    status = ownership.measurement_status(length, F.col("excluded"), F.coalesce("supported", F.lit(0.0)))
    reason = F.when(status == "excluded", "noise").when(status == "unavailable", "no_length").when(status == "partial", "short_support")
    return t.select(
        "root_id", "root_order", length.alias("length"), (F.col("chord") * k).alias("chord"), "tortuosity", (F.col("mean_radius") * 2 * k).alias("mean_diameter"), (F.col("lateral_area") * k * k).alias("lateral_area"), (F.col("volume") * k * k * k).alias("volume"),
        status.alias("length_measurement_status"), status.isin("complete", "partial").alias("length_measurement_eligible"), reason.alias("length_measurement_reason"),
    )


def nodule_quantities(patches: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per nodule its area-weighted centre, area, extent, and supporting root.

    ``patches``: nodule_id, id, x, y, z, weight (a third of the area at a vertex); ``contacts``: nodule_id, label (of each
    vertex next to it). The root is that of 70 percent or more of the neighbours, else missing.
    """
    w = F.col("weight")
    q = patches.groupBy("nodule_id").agg(F.count("*").alias("vertices"), F.sum(w).alias("area"), *((F.sum(w * F.col(a)) / F.sum(w)).alias(f"c{a}") for a in "xyz"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("extent"))
    n = contacts.groupBy("nodule_id", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("nodule_id").agg(F.max(F.struct("n", "label")).alias("t"), F.sum("n").alias("every"))
    return q.join(top.select("nodule_id", F.when(F.col("t.n") >= 0.7 * F.col("every"), F.col("t.label")).alias("root")), "nodule_id", "left")


def reassign(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels with those of ``changes`` (id, label) put over them."""
    return labels.join(changes.select("id", F.col("label").alias("_new")), "id", "left").select("id", F.coalesce("_new", "label").alias("label"))


def step_times(runs: DataFrame, last: int = 50) -> DataFrame:
    """The median duration of each step over its last runs: step, seconds, runs. ``runs``: step, ended_at, seconds."""
    w = W.partitionBy("step").orderBy(F.desc("ended_at"), "seconds")
    return runs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= last).groupBy("step").agg(F.percentile("seconds", 0.5).alias("seconds"), F.count("*").alias("runs"))
