"""Who owns a vertex: scores of the decisions as column expressions, and the rules on frozen snapshots as joins.

A rule reads the labels of one generation and proposes changes; proposals that disagree are withheld. Labels: 0 primary,
1.. laterals, -1 unassigned, -2 uncertain, -3 and below no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arborline.functions import geometry as g
from arborline.operators.graph import components

UNASSIGNED, UNCERTAIN = -1, -2

# Scores. The weights are fixed values that make results comparable with published ones.


def growth_score(turn_cosine: Column, density: Column, distance: Column, step: float) -> Column:
    """Of a step of a growing path; ``density`` scaled to 0..1."""
    return 0.57 * turn_cosine + 0.20 * density - 0.15 * F.abs(distance - step) / step


def attachment_cost(gap: Column, tolerance: float, separation: Column, preferred: Column) -> Column:
    """Of hanging a root on a parent: less is better; the stated parent has an advantage."""
    return gap / tolerance + 0.25 * (1 - separation) - F.when(preferred, 0.45).otherwise(0.0)


def collar_cost(distance: Column, radius: Column, spacing: float, outward: Column, continuity: Column, geodesic: Column) -> Column:
    """Of a vertex near a branching for an owner."""
    size = radius + spacing
    return distance / size + 0.25 * F.abs(distance - radius) / size + 0.4 * F.greatest(0.2 - outward, F.lit(0.0)) + 0.2 * (1 - continuity) + 0.15 * geodesic


def primary_score(basal: Column, radius: Column, continuity: Column, down: Column, length: Column, centrality: Column) -> Column:
    """Of a candidate main axis; all features scaled to 0..1."""
    return 0.20 * basal + 0.22 * (0.45 * radius + 0.55 * continuity) + 0.24 * down + 0.19 * length + 0.15 * centrality


def fork_score(direction: Column, fork: Column, length: Column, child: Column, parent: Column) -> Column:
    """Of a continuation at a fork, less the penalty of a child longer than its parent."""
    return 0.55 * direction + 0.35 * fork + 0.10 * length - g.excess_penalty(child, parent)


def patch_unary(vertices: Column, distance: Column, residual: Column, direction: Column, connected: Column) -> Column:
    """Cost of a surface patch for an owner."""
    return vertices * (distance + 0.25 * residual + 0.6 * direction + F.when(connected, 0.0).otherwise(0.4))


def footprint_status(components_: Column, boundary_loops: Column, euler: Column, area: Column, span: Column, geodesic: Column, compactness: Column, radius: Column, spacing: float, sine: Column) -> Column:
    """The verdict on where a root meets its parent: unresolved before rejected before accepted."""
    f = F.least(F.lit(1.5), 1 / F.greatest(sine, F.lit(1e-6)))
    return (
        F.when(radius.isNull(), "unresolved_radius")
        .when(components_ != 1, "rejected_components")
        .when((boundary_loops != 1) | (euler != 1), "rejected_topology")
        .when(area > 1.5 * 3.141592653589793 * radius * radius * f, "rejected_area")
        .when(span > 5 * radius * f + 2 * spacing, "rejected_span")
        .when(geodesic > 6 * radius * f + 2 * spacing, "rejected_geodesic")
        .when(compactness > 6 * f, "rejected_compactness")
        .otherwise("accepted")
    )


def measurement_status(value: Column, excluded: Column, supported: Column) -> Column:
    """State of a metric: excluded, unavailable (no finite positive value), complete or partial by the supported share."""
    good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value != float("inf"))
    return F.when(F.coalesce(excluded, F.lit(False)), "excluded").when(~good | value.isNull(), "unavailable").when(supported >= 1.0, "complete").otherwise("partial")


# Evidence


def origin_coverage(axial: Column, spacing: float, attached: Column) -> Column:
    return attached & (F.abs(axial) <= 1.5 * spacing)


def parent_radii(distances: DataFrame, spacing: float, by: list[str]) -> DataFrame:
    """A parent's radius at its nodes: by, node_id, radius. ``distances``: by, node_id, distance of each supporting point.

    The 70th percentile where three or more points support a node, gaps filled linearly, the median of five neighbours,
    never below max(2.5 spacings, 0.002).
    """
    from arborline.operators.polyline import fill_linear

    raw = distances.groupBy(*by, "node_id").agg(F.when(F.count("distance") >= 3, F.percentile("distance", 0.7)).alias("radius"))
    full = fill_linear(raw, "radius", "node_id", by)
    w = W.partitionBy(*by).orderBy("node_id").rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list("radius").over(w))
    middle = (F.element_at(near, (F.floor((F.size(near) - 1) / 2) + 1).cast("int")) + F.element_at(near, (F.ceil((F.size(near) - 1) / 2) + 1).cast("int"))) / 2
    return full.select(*by, "node_id", F.greatest(F.when(F.size(near) > 0, middle), F.lit(max(2.5 * spacing, 0.002))).alias("radius"))


def station_radii(offsets: DataFrame, by: list[str]) -> DataFrame:
    """A radius per station from points in its slab: by, station, radius, gap. ``offsets``: by, station, u, v (across the axis).

    The 65th percentile of the distance where three or more points leave no angular gap of more than half a turn, else missing.
    """
    turn = F.atan2("v", "u")
    w = W.partitionBy(*by, "station").orderBy("turn")
    first = F.min("turn").over(W.partitionBy(*by, "station"))
    o = offsets.withColumn("turn", turn).withColumn("next", F.coalesce(F.lead("turn").over(w), first + 2 * 3.141592653589793))
    s = o.groupBy(*by, "station").agg(F.count("*").alias("n"), F.max(F.col("next") - F.col("turn")).alias("gap"), F.percentile(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 0.65).alias("r"))
    return s.select(*by, "station", F.when((F.col("n") >= 3) & (F.col("gap") <= 3.141592653589793), F.col("r")).alias("radius"), "gap")


def arc_weighted_radius(profile: DataFrame, by: list[str]) -> DataFrame:
    """Mean radius weighted by the length that each value stands for: by, radius. ``profile``: by, arc, radius."""
    w = W.partitionBy(*by).orderBy("arc")
    step = F.lead("arc").over(w) - F.col("arc")
    mean = (F.col("radius") + F.lead("radius").over(w)) / 2
    return profile.select(*by, step.alias("h"), (step * mean).alias("hr")).filter("hr is not null").groupBy(*by).agg(g.ratio(F.sum("hr"), F.sum("h")).alias("radius"))


def arc_median_radius(profile: DataFrame, by: list[str]) -> DataFrame:
    """The radius that half of the length does not exceed, with the radius linear between nodes: by, radius.

    ``profile``: by, node_id, arc, radius. The distribution function is piecewise linear between the radii of the nodes, so
    its inverse at one half is exact.
    """
    w = W.partitionBy(*by).orderBy("node_id")
    r1 = F.lead("radius").over(w)
    s = profile.select(*by, (F.lead("arc").over(w) - F.col("arc")).alias("h"), F.least("radius", r1).alias("lo"), F.greatest("radius", r1).alias("hi")).filter("h > 0 and lo is not null and hi is not null")
    # At a place r the function rises by the flat pieces there; between places its slope is that of the pieces that span them.
    slope = F.col("h") / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    marks = s.filter("hi > lo").select(*by, F.explode(F.array(F.struct(F.col("lo").alias("r"), slope.alias("rise"), F.lit(0.0).alias("flat")), F.struct(F.col("hi").alias("r"), (-slope).alias("rise"), F.lit(0.0).alias("flat")))).alias("m")).select(*by, "m.*")
    marks = marks.unionByName(s.filter("hi = lo").select(*by, F.col("lo").alias("r"), F.lit(0.0).alias("rise"), F.col("h").alias("flat")))
    at = marks.groupBy(*by, "r").agg(F.sum("rise").alias("rise"), F.sum("flat").alias("flat"))
    o = W.partitionBy(*by).orderBy("r")
    past = o.rowsBetween(W.unboundedPreceding, -1)
    steep = at.withColumn("r0", F.lag("r").over(o)).withColumn("slope", F.coalesce(F.sum("rise").over(past), F.lit(0.0)))
    grown = F.coalesce((F.col("r") - F.col("r0")) * F.col("slope"), F.lit(0.0))
    up_to = steep.withColumn("grown", grown).withColumn("before", F.sum(grown).over(o.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("flat").over(past), F.lit(0.0)))
    total = s.groupBy(*by).agg(F.sum("h").alias("total"))
    f = up_to.join(total, by).withColumn("half", F.col("total") / 2).filter(F.col("before") + F.col("flat") >= F.col("half") * (1 - 2e-12))
    first = f.groupBy(*by).agg(F.min(F.struct("r", "r0", "slope", "grown", "before", "half")).alias("m")).select(*by, "m.*")
    inside = F.col("r") - (F.col("before") - F.col("half")) / F.when(F.col("slope") > 0, F.col("slope"))
    return first.select(*by, F.when((F.col("before") <= F.col("half")) | (F.col("grown") <= 0) | F.col("r0").isNull(), F.col("r")).otherwise(inside).alias("radius"))


# Attachments and conflicts


def best_attachment(candidates: DataFrame, tolerance: float) -> DataFrame:
    """The best parent of each root: root_id, parent_id, cost, attached. ``candidates``: root_id, parent_id, end, gap, separation, preferred."""
    c = candidates.withColumn("cost", attachment_cost(F.col("gap"), tolerance, F.col("separation"), F.col("preferred")))
    best = c.groupBy("root_id").agg(F.min(F.struct("cost", "parent_id", "end", "gap")).alias("b"))
    return best.select("root_id", F.col("b.parent_id").alias("parent_id"), F.col("b.end").alias("end"), F.col("b.cost").alias("cost"), (F.col("b.gap") <= tolerance).alias("attached"))


def resolve_junctions(assigned: DataFrame, roots: DataFrame) -> DataFrame:
    """Uncertain vertices between a root and its own parent go to the parent, where the root has not yet left it.

    ``assigned``: id, label, owner, rival, arc (of the vertex on the child); ``roots``: label, parent, body_start (arc at
    which the root leaves its parent). Returns id, label.
    """
    link = roots.select(F.col("label").alias("child"), "parent", "body_start")
    pair = [(F.col("owner") == F.col("child")) & (F.col("rival") == F.col("parent")), (F.col("rival") == F.col("child")) & (F.col("owner") == F.col("parent"))]
    open_ = assigned.filter(F.col("label") == UNCERTAIN)
    won = open_.join(link, pair[0] & (F.col("arc") <= F.col("body_start")), "inner").select("id", F.col("parent").alias("new"))
    lost = open_.join(link, pair[1] & (F.col("arc") <= F.col("body_start")), "inner").select("id", F.col("parent").alias("new"))
    new = won.unionByName(lost).groupBy("id").agg(F.min("new").alias("new"))
    return assigned.join(new, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def merge_proposals(frozen: DataFrame, *proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels after independent proposals (id, label), and the ids on which they disagree, which keep their label."""
    every = proposals[0].select("id", "label")
    for p in proposals[1:]:
        every = every.unionByName(p.select("id", "label"))
    said = every.groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    out = frozen.join(said, "id", "left").select("id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("label")).alias("label"))
    return out, said.filter("low <> high").select("id")


def commit(labels: DataFrame, ledger: DataFrame, regions: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """All or nothing: labels after the regions, and the breaches that forbid them (then the labels stay).

    ``labels``: id, label, generation; ``ledger``: id, generation, candidates; ``regions``: region, id, owner. Every vertex
    must be uncertain, of this generation, in one region only, and have the owner among its recorded candidates.
    """
    n = regions.groupBy("id").agg(F.countDistinct("region").alias("regions"), F.min("owner").alias("owner"))
    at = n.join(labels, "id", "left").join(ledger.select("id", F.col("generation").alias("recorded"), "candidates"), "id", "left")
    breach = (
        F.when(F.col("label").isNull(), "unknown_vertex").when(F.col("generation") != generation, "stale_generation").when(F.col("regions") > 1, "overlap")
        .when(F.col("label") != UNCERTAIN, "not_uncertain").when(~F.col("recorded").eqNullSafe(F.lit(generation)), "not_recorded").when(~F.coalesce(F.array_contains("candidates", F.col("owner")), F.lit(False)), "not_a_candidate")
    )
    breaches = at.select("id", breach.alias("breach")).filter("breach is not null")
    if not breaches.isEmpty():
        return labels, breaches
    new = n.select("id", "owner")
    out = labels.join(new, "id", "left").select("id", F.coalesce("owner", "label").alias("label"), F.lit(generation + 1).alias("generation"))
    return out, breaches


# Patches of one label


def patches(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Connected vertices of one label: id, label, patch. ``edges``: u, v; ``labels``: id, label."""
    a = edges.join(labels.select(F.col("id").alias("u"), F.col("label").alias("ul")), "u").join(labels.select(F.col("id").alias("v"), F.col("label").alias("vl")), "v").filter("ul = vl")
    return components(a.select("u", "v"), labels.select("id")).withColumnRenamed("component", "patch").join(labels, "id").select("id", "label", "patch")


def patch_table(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per patch its label, size, whether it is its label's largest, and the neighbour label with the most border edges and its share."""
    p = patches(edges, labels)
    size = p.groupBy("patch", "label").agg(F.count("*").alias("vertices"))
    main = F.row_number().over(W.partitionBy("label").orderBy(F.desc("vertices"), "patch")) == 1
    b = edges.join(p.select(F.col("id").alias("u"), F.col("patch").alias("pu"), F.col("label").alias("ul")), "u").join(p.select(F.col("id").alias("v"), F.col("patch").alias("pv"), F.col("label").alias("vl")), "v").filter("ul <> vl")
    b = b.select(F.col("pu").alias("patch"), F.col("vl").alias("other")).unionByName(b.select(F.col("pv").alias("patch"), F.col("ul").alias("other")))
    n = b.groupBy("patch", "other").agg(F.count("*").alias("n"))
    top = n.groupBy("patch").agg(F.max(F.struct("n", -F.col("other"))).alias("t"), F.sum("n").alias("border"), F.max_by("other", F.struct("n", -F.col("other"))).alias("neighbour"))
    return size.withColumn("main", main).join(top, "patch", "left").select("patch", "label", "vertices", "main", "neighbour", (F.col("t.n") / F.col("border")).alias("share"))


def island_proposals(edges: DataFrame, labels: DataFrame, share: float = 0.75) -> DataFrame:
    """Patches apart from their root's main body with a clear neighbour go to it: id, label."""
    t = patch_table(edges, labels).filter((F.col("label") > 0) & ~F.col("main") & (F.col("share") >= share) & (F.col("neighbour") >= 0))
    return patches(edges, labels).join(t.select("patch", "neighbour"), "patch").select("id", F.col("neighbour").alias("label"))


def splits(edges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Roots that a change would remove or cut into more parts: label, parts_before, parts_after."""
    n = lambda x, name: patches(edges, x).groupBy("label").agg(F.countDistinct("patch").alias(name))
    t = n(before, "parts_before").join(n(after, "parts_after"), "label", "left").filter("label >= 0")
    return t.filter(F.col("parts_after").isNull() | (F.col("parts_after") > F.col("parts_before"))).select("label", "parts_before", F.coalesce("parts_after", F.lit(0)).cast("long").alias("parts_after"))


def assignment_summary(labels: DataFrame) -> DataFrame:
    """One row: vertices by state."""
    l = F.col("label")
    return labels.agg(F.count("*").alias("vertices"), F.count_if(l == 0).alias("primary"), F.count_if(l > 0).alias("lateral"), F.count_if(l == UNASSIGNED).alias("unassigned"), F.count_if(l == UNCERTAIN).alias("uncertain"), F.count_if(l <= -3).alias("other"))
