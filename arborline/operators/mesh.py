"""Triangle meshes as tables: ``vertices`` (id, x, y, z, ...) and ``faces`` (face_id, a, b, c with vertex ids)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborline.common import finite
from arborline.functions import geometry as g
from arborline.operators.graph import components


def finite_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices with three finite coordinates; the ids stay, so faces need no new numbers."""
    return vertices.filter(reduce(lambda p, q: p & q, (finite(a).isNotNull() for a in "xyz")))


def corners(faces: DataFrame, vertices: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Faces with the given columns of their corners as a_x, b_x, ...; faces with a corner that is not there go."""
    out = faces
    for k in "abc":
        out = out.join(vertices.select(F.col("id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns)), k)
    return out


def proper(faces: DataFrame) -> DataFrame:
    """Faces with three different corners."""
    return faces.filter((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))


def sanitize(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces whose corners are all there and finite."""
    ok, columns = finite_vertices(vertices).select("id"), faces.columns
    for k in "abc":
        faces = faces.join(ok.withColumnRenamed("id", k), k, "left_semi")
    return faces.select(*columns)


def _p(k: str) -> list[Column]:
    return [F.col(f"{k}_{a}") for a in "xyz"]


def face_measures(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds ``area`` and ``volume`` (signed, with the origin) to the faces with their corners."""
    return corners(faces, vertices).withColumn("area", g.triangle_area(_p("a"), _p("b"), _p("c"))).withColumn("volume", g.signed_volume(_p("a"), _p("b"), _p("c")))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges: u < v, incidence (faces at it), balance (0 if their directions cancel)."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("way"))
    e = proper(faces).select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).select("e.*")
    return e.groupBy("u", "v").agg(F.count("*").alias("incidence"), F.sum("way").alias("balance"))


def duplicate_faces(faces: DataFrame) -> DataFrame:
    """Corner triples that occur in more than one face: corners (sorted), copies."""
    key = F.array_sort(F.array("a", "b", "c"))
    return faces.groupBy(key.alias("corners")).agg(F.count("*").alias("copies")).filter("copies > 1").select(F.element_at("corners", 1).alias("a"), F.element_at("corners", 2).alias("b"), F.element_at("corners", 3).alias("c"), "copies")


def audit(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: faces, degenerate, duplicates, area, signed volume, boundary, non-manifold and inconsistent edges, closed."""
    e = edges(faces).agg(
        F.count("*").alias("edges"), F.count_if(F.col("incidence") == 1).alias("boundary_edges"), F.count_if(F.col("incidence") > 2).alias("non_manifold_edges"),
        F.count_if((F.col("incidence") == 2) & (F.col("balance") != 0)).alias("inconsistent_edges"),
    )
    m = face_measures(faces, vertices)
    bad = (F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))
    f = m.agg(F.count("*").alias("faces"), F.count_if(bad).alias("degenerate_faces"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("signed_volume"))
    d = duplicate_faces(faces).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_faces"))
    out = f.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(d))  # one row each
    return out.withColumn("closed", (F.col("edges") > 0) & (F.col("boundary_edges") == 0) & (F.col("non_manifold_edges") == 0) & (F.col("inconsistent_edges") == 0))


def component_volumes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per connected component its faces, area and volume.

    The volume is summed around a vertex of the component itself (that of least id), or large coordinates would cancel out
    all digits.
    """
    e = edges(faces)
    c = components(e, vertices.select("id"))
    own = proper(faces).join(c.withColumnRenamed("id", "a"), "a")
    origin = vertices.select(F.col("id").alias("component"), *(F.col(a).alias(f"o{a}") for a in "xyz"))
    m = corners(own, vertices).join(origin, "component")
    a, b, cc = (g.minus(_p(k), [F.col(f"o{x}") for x in "xyz"]) for k in "abc")
    m = m.withColumn("area", g.triangle_area(a, b, cc)).withColumn("volume", g.signed_volume(a, b, cc))
    return m.groupBy("component").agg(F.count("*").alias("faces"), F.sum("area").alias("area"), F.abs(F.sum("volume")).alias("volume"))


def origin_sensitivity(faces: DataFrame, vertices: DataFrame, shift: float = 1.0) -> DataFrame:
    """How much the volume of a selected surface depends on the origin: least and greatest over seven origins.

    The volume around a shifted origin is linear in the shift (its slope is the summed vector area), so one aggregate
    gives all seven; a closed surface has spread 0.
    """
    n = g.cross(g.minus(_p("b"), _p("a")), g.minus(_p("c"), _p("a")))
    s = face_measures(faces, vertices).agg(F.sum("volume").alias("v"), *(F.sum(c / 6.0).alias(f"n{a}") for c, a in zip(n, "xyz")))
    slope = F.greatest(*(F.abs(F.col(f"n{a}")) for a in "xyz")) * F.lit(float(shift))
    return s.select(F.col("v").alias("volume"), (F.col("v") - slope).alias("least"), (F.col("v") + slope).alias("greatest"), (2 * slope).alias("spread"))


def surface_by_owner(faces: DataFrame, vertices: DataFrame, mode: str = "majority") -> DataFrame:
    """Area by the label of its vertices: label, area.

    ``majority``: a face counts for the label that two of its corners have; with three different ones for nobody.
    ``thirds``: each corner's label gets a third. ``vertices``: id, x, y, z, label.
    """
    m = corners(faces, vertices, ("x", "y", "z", "label")).withColumn("area", g.triangle_area(_p("a"), _p("b"), _p("c")))
    a, b, c = (F.col(f"{k}_label") for k in "abc")
    if mode == "thirds":
        m = m.select(F.explode(F.array(a, b, c)).alias("label"), (F.col("area") / 3).alias("area"))
    else:
        m = m.select(F.when((a == b) | (a == c), a).when(b == c, b).alias("label"), "area").filter("label is not null")
    return m.groupBy("label").agg(F.sum("area").alias("area"), F.count("*").alias("parts"))


def vertex_weights(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """A third of the area of each face at a vertex; vertices without area get the median of the others."""
    m = face_measures(faces, vertices)
    w = m.select(F.explode(F.array("a", "b", "c")).alias("id"), (F.col("area") / 3).alias("w")).groupBy("id").agg(F.sum("w").alias("w"))
    w = w.filter("w > 0")
    median = w.agg(F.percentile("w", 0.5).alias("median"))
    return vertices.select("id").join(w, "id", "left").crossJoin(F.broadcast(median)).select("id", F.coalesce("w", "median").alias("weight"))


def contact_edges(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs of labels that meet along edges: low, high, edges."""
    e = edges(faces).join(vertices.select(F.col("id").alias("u"), F.col("label").alias("ul")), "u").join(vertices.select(F.col("id").alias("v"), F.col("label").alias("vl")), "v")
    e = e.filter("ul <> vl")
    return e.groupBy(F.least("ul", "vl").alias("low"), F.greatest("ul", "vl").alias("high")).agg(F.count("*").alias("edges"))


def primary_contacts(faces: DataFrame, vertices: DataFrame, orders: DataFrame) -> DataFrame:
    """Roots of order 2 or more that touch the primary (label 0): label, root_order, edges. ``orders``: label, root_order."""
    c = contact_edges(faces, vertices).filter("low = 0 and high > 0")
    return c.join(orders, c["high"] == orders["label"]).filter("root_order >= 2").select("label", "root_order", "edges")


def position_index(vertices: DataFrame) -> DataFrame:
    """The first vertex at each exact position: id, representative (negative zero counts as zero)."""
    at = [(F.col(a) + F.lit(0.0)).alias(f"k{a}") for a in "xyz"]
    keyed = vertices.select("id", *at)
    first = keyed.groupBy("kx", "ky", "kz").agg(F.min("id").alias("representative"))
    return keyed.join(first, ["kx", "ky", "kz"]).select("id", "representative")


def seam_index(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``id, representative``: vertices at one position merged, but only where that leaves a closed, oriented surface.

    A vertex is safe if all edges at its position, after merging, have two faces in opposite directions; others keep
    their own index.
    """
    p = position_index(vertices)
    merged = faces
    for k in "abc":
        merged = merged.join(p.withColumnRenamed("id", k).withColumnRenamed("representative", f"{k}_"), k).drop(k).withColumnRenamed(f"{k}_", k)
    bad = edges(merged).filter("incidence <> 2 or balance <> 0")
    degenerate = merged.filter((F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))).select(F.explode(F.array("a", "b", "c")).alias("representative"))
    unsafe = bad.select(F.explode(F.array("u", "v")).alias("representative")).union(degenerate).distinct().withColumn("unsafe", F.lit(True))
    return p.join(unsafe, "representative", "left").select("id", F.when(F.col("unsafe"), F.col("id")).otherwise(F.col("representative")).alias("representative"))


def corner_weights(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """A third of the area of its faces at each vertex that has any: id, weight."""
    thirds = face_measures(faces, vertices).select(F.explode(F.array("a", "b", "c")).alias("id"), (F.col("area") / 3).alias("w"))
    return thirds.groupBy("id").agg(F.sum("w").alias("weight"))


def drop_hidden(faces: DataFrame, vertices: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and whole faces without the ``hidden`` ids."""
    v = vertices.join(hidden.select("id"), "id", "left_anti")
    f = faces
    for k in "abc":
        f = f.join(hidden.select(F.col("id").alias(k)), k, "left_anti")
    return f.select(*faces.columns), v


def noise_components(faces: DataFrame, vertices: DataFrame, dominant: float = 0.9, area_share: float = 0.001, extent_share: float = 0.02, elongation: float = 4.0) -> DataFrame:
    """Per component whether it is disconnected noise and why not: component, area, extent, verdict.

    Noise is tiny in area and extent, compact and closed, and only where one component dominates the whole.
    """
    c = components(edges(faces), vertices.select("id"))
    v = vertices.join(c, "id")
    size = v.groupBy("component").agg(*(F.max(a) - F.min(a) for a in "xyz"))
    size = size.toDF("component", "dx", "dy", "dz").withColumn("extent", F.greatest("dx", "dy", "dz"))
    slim = F.array_sort(F.array("dx", "dy", "dz"))
    e = edges(faces).join(c.withColumnRenamed("id", "u"), "u").groupBy("component").agg(F.min(((F.col("incidence") == 2) & (F.col("balance") == 0)).cast("int")).alias("closed"))
    a = component_volumes(faces, vertices).select("component", "area")
    t = size.join(a, "component", "left").join(e, "component", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    whole = t.agg(F.sum("area").alias("all_area"), F.max("area").alias("top_area"), F.max("extent").alias("top_extent"))
    t = t.crossJoin(F.broadcast(whole))
    verdict = (
        F.when(F.col("top_area") < dominant * F.col("all_area"), "no_dominant_component")
        .when(F.col("area") == F.col("top_area"), "dominant")
        .when(F.col("area") > area_share * F.col("all_area"), "too_large")
        .when(F.col("extent") > extent_share * F.col("top_extent"), "too_long")
        .when(F.element_at(slim, 3) > elongation * F.greatest(F.element_at(slim, 2), F.lit(1e-300)), "elongated")
        .when(F.coalesce("closed", F.lit(0)) == 0, "not_closed")
        .otherwise("noise")
    )
    return t.select("component", "area", "extent", verdict.alias("verdict"))
