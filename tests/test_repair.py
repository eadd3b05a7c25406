import random

import numpy as np
import pytest

from arborline.operators import ownership, repair, spatial, tracing


def test_promotion_stops_on_circles_and_missing_places(spark):
    at = lambda r, p, x: ("s", r, p, x, 0.0, 0.0, x, 0.0, 0.0, x, 0.0, 0.0)
    kind = "sample_id string, root_id string, parent_id string, " + ", ".join(f"{k}{a} double" for k in "isb" for a in "xyz")
    rows = [at("p", None, 0.0), at("a", "p", 0.0), at("b", "a", 0.0), at("c", "b", 9.0), at("u", "v", 0.0), at("v", "u", 0.0), at("n", "a", None)]
    got = {r["root_id"]: (r["parent_id"], r["steps"]) for r in repair.promote_base_children(spark.createDataFrame(rows, kind), 1.0).collect()}
    assert got == {"p": (None, 0), "a": ("p", 0), "b": ("p", 1), "c": ("b", 0), "u": ("v", 0), "v": ("u", 0), "n": ("a", 0)}
    assert repair.promote_base_children(spark.createDataFrame([], kind), 1.0).count() == 0


def test_absorb_follows_chains_and_keeps_circles(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "root_id long, parent_id long")
    merged = spark.createDataFrame([*((i, i - 1) for i in range(5, 30)), (33, 34), (34, 33), (36, 36), (None, 1)], "root_id long, into long")
    got = {r["root_id"]: r["parent_id"] for r in repair.absorb(links, merged).collect()}
    assert set(got) == {*range(1, 5), *range(30, 40)} and got[30] == 4 and got[33] == 32 and got[37] == 36
    assert repair.absorb(links, merged.limit(0)).count() == 39


def mesh(spark, labels):
    """A strip of squares as edges, a label for each column of two."""
    e = [(2 * i + a, 2 * i + 2 + a) for i in range(len(labels) - 1) for a in (0, 1)] + [(2 * i, 2 * i + 1) for i in range(len(labels))]
    return spark.createDataFrame(e, "u long, v long"), spark.createDataFrame([(2 * i + a, l) for i, l in enumerate(labels) for a in (0, 1)], "id long, label int")


def columns(df):
    got = {r["id"]: r["label"] for r in df.collect()}
    return [got[2 * i] for i in range(len(got) // 2)]


def test_guard_withholds_what_splits_or_consumes(spark):
    e, l = mesh(spark, [0, 0, 1, 1, 1, 1, 2, 2])
    cut_middle = l.filter("id in (6, 7)").withColumn("label", l["label"] * 0 + 2)
    after, held = repair.guarded(e, l, cut_middle)
    assert columns(after) == [0, 0, 1, 1, 1, 1, 2, 2] and {r["label"] for r in held.collect()} >= {1}
    edge = spark.createDataFrame([(10, 2), (11, 2)], "id long, label int")
    assert columns(repair.guarded(e, l, edge)[0]) == [0, 0, 1, 1, 1, 2, 2, 2]
    gone = spark.createDataFrame([(12, 1), (13, 1), (14, 1), (15, 1)], "id long, label int")
    assert columns(repair.guarded(e, l, gone)[0]) == [0, 0, 1, 1, 1, 1, 2, 2]


def test_higher_orders_let_go_of_the_primary(spark):
    e, l = mesh(spark, [0, 0, 2, 2, 2, 0, 1, 1])
    orders = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "label int, root_order int")
    assert columns(repair.restrict_primary_contacts(e, l, orders)) == [0, 0, -2, 2, -2, 0, 1, 1]
    e, l = mesh(spark, [0, 0, 2, 0, 0])  # all of it touches: nothing may go
    assert columns(repair.restrict_primary_contacts(e, l, orders)) == [0, 0, 2, 0, 0]


def test_detached_patches_go_to_the_parent(spark):
    e, l = mesh(spark, [1, 1, 1, 2, 2, 2, 1, 1, 2, 1, 1])
    parents = spark.createDataFrame([(2, 1), (1, 0)], "label int, parent int")
    assert columns(repair.transfer_parent_patches(e, l, parents)) == [1, 1, 1, 2, 2, 2, 1, 1, 1, 1, 1]


def test_islands_holes_and_arms(spark):
    e, l = mesh(spark, [1, 1, 1, -1, 1, 2, 2, 2, 1, 2, -1, -1, -1])
    # All moves are of one snapshot: two columns too small to stay have no clear neighbour in it and become unassigned.
    assert columns(repair.clean_surface(e, l)) == [1, 1, 1, 1, -1, 2, 2, 2, 2, -1, 2, 2, 2]
    forked = spark.createDataFrame([(2,)], "label int")
    assert columns(repair.recover_arms(e, l, forked, 6)) == [1, 1, 1, -1, 1, 2, 2, 2, 1, 2, 2, 2, 2]
    assert columns(repair.recover_arms(e, l, forked, 7)) == [1, 1, 1, -1, 1, 2, 2, 2, 1, 2, -1, -1, -1]


def test_repaired_hierarchy_has_no_circles(spark):
    from datetime import datetime

    rows = [("s", r, p, 9, i, c, datetime(2024, 1, 1)) for i, (r, p, c) in enumerate([("primary", None, 1.0), ("a", "primary", 0.9), ("b", "a", 0.1), ("c", "b", 0.9), ("x", "y", 0.5), ("y", "x", 0.6), ("z", "nowhere", 0.9)])]
    df = spark.createDataFrame(rows, "sample_id string, root_id string, parent_id string, root_order int, insertion_index int, confidence double, recorded_at timestamp")
    got = {r["root_id"]: (r["parent_id"], r["root_order"], r["stable_id"]) for r in repair.repair_hierarchy(df, 0.2).collect()}
    assert got == {"primary": (None, 0, "primary"), "a": ("primary", 1, "root-o1-001"), "x": ("primary", 1, "root-o1-002"), "y": ("x", 2, "root-o2-001")}


def test_remeasured_without_hidden_nodes(spark):
    n = spark.createDataFrame([(1, k, float(k), 0.0, 0.0, 1.0) for k in range(6)], "root_id long, node_id long, x double, y double, z double, radius double")
    roots = spark.createDataFrame([(1, 1, False), (2, 1, False)], "root_id long, root_order int, excluded boolean")
    support = spark.createDataFrame([(1, 1.0)], "root_id long, supported double")
    hidden = spark.createDataFrame([(1, 5), (1, 4), (9, 9)], "root_id long, node_id long")
    got = {r["root_id"]: r for r in repair.remeasure_visible(n, roots, support, hidden, 2.0).collect()}
    assert got[1]["length"] == 6.0 and got[2]["length"] is None and got[2]["length_measurement_status"] == "unavailable"


def test_median_radius_against_sampling(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for root in range(6):
        arc, r = np.r_[0, np.cumsum(rng.uniform(0.1, 2, 14))], rng.integers(1, 5, 15).astype(float) + (root % 2) * rng.uniform(0, 1, 15)
        rows += [(root, i, float(a), float(b)) for i, (a, b) in enumerate(zip(arc, r))]
        want[root] = np.median(np.interp(np.linspace(0, arc[-1], 400_001), arc, r))
    got = {x["root_id"]: x["radius"] for x in ownership.arc_median_radius(spark.createDataFrame(rows, "root_id long, node_id long, arc double, radius double"), ["root_id"]).collect()}
    assert got == {k: pytest.approx(v, abs=1e-3) for k, v in want.items()}


def test_crowded_places_and_skewed_cells(spark):
    rng = random.Random(4)
    rows = [(i, 0.5, 0.5, 0.5) for i in range(1500)] + [(2000 + i, rng.random(), rng.random(), rng.random()) for i in range(300)] + [(5000, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got: dict = {}
    for r in spatial.knn(p, 3).collect():
        got.setdefault(r["a_id"], []).append((r["rank"], r["b_id"], r["distance"]))
    xyz = {i: np.array([x, y, z]) for i, x, y, z in rows if x is not None}
    for i in [0, 1, 2, 3, 700, *range(2000, 2300, 13)]:
        want = sorted((round(float(np.linalg.norm(xyz[i] - v)), 9), j) for j, v in xyz.items() if j != i)[:3]
        assert [(round(dd, 9), j) for _, j, dd in sorted(got[i])] == want
    assert len(got) == 1800


def test_grid_join_can_be_split_by_skew(spark):
    """Both sides are shuffled by the join itself, which leaves AQE free to split a crowded part."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    try:
        a = spark.range(60_000).selectExpr("id as a_id", "if(id < 50000, 0.5, rand(1) * 90) as x", "if(id < 50000, 0.5, rand(2) * 90) as y", "if(id < 50000, 0.5, rand(3) * 90) as z")
        b = spark.range(2_000).selectExpr("id as b_id", "rand(4) * 90 as x", "rand(5) * 90 as y", "rand(6) * 90 as z")
        pairs = spatial.within(a, b, 1.0)
        pairs.collect()
        assert "skew=true" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_copies_of_the_axis(spark):
    line = [(k, float(k), 0.0, 0.0, 1.0, 0.0, 0.0) for k in range(10)]
    kind = "node_id long, x double, y double, z double, tx double, ty double, tz double"
    parents = spark.createDataFrame(line, kind)
    c = spark.createDataFrame([(1, *r) for r in line] + [(2, k, float(k), 50.0, 0.0, 1.0, 0.0, 0.0) for k in range(3)] + [(3, k, 5.0, k / 10, 0.0, 0.0, 1.0, 0.0) for k in range(5)], "candidate_id long, " + kind)
    assert {r["candidate_id"]: r["copy"] for r in tracing.tracking_copies(c, parents, 0.1).collect()} == {1: True, 2: False, 3: False}
