import math

import pytest
from pyspark.sql import functions as F

from arborline.operators import tracing as t

P = "id long, x double, y double, z double"


def tube(spark, n=400):
    return spark.createDataFrame([(i, 0.1 * math.cos(2.4 * i), 0.1 * math.sin(2.4 * i), i / n) for i in range(n)], P)


def test_samples(spark):
    p = tube(spark)
    small, large = t.analysis_sample(p, 0.1), t.analysis_sample(p, 0.5)
    a, b = {r["id"] for r in small.collect()}, {r["id"] for r in large.collect()}
    assert a < b and {0, 399} <= a and 20 < len(a) < 70 and small.count() == len(a)
    assert t.analysis_target(1000, 1, 1, 0.1) == 1.0 and t.analysis_target(1_000_000, 100, 1, 0.05) == pytest.approx(0.1) and t.analysis_target(1_000_000, 1, 1, 0.05) == 0.05


def test_tube_and_stations(spark):
    p = tube(spark)
    nodes = spark.createDataFrame([(i, 0.0, 0.0, i / 20, 0.1) for i in range(21)], "node_id long, x double, y double, z double, radius double")
    far = spark.createDataFrame([(1000, 0.9, 0.0, 0.5)], P)
    inside = {r["id"]: r["inside"] for r in t.tube_mask(p.union(far), nodes, 0.01).collect()}
    assert sum(inside.values()) >= 395 and not inside[1000]
    s = spark.createDataFrame([(i, 0.02, 0.01, 0.2 + 0.1 * i, 0.0, 0.0, 1.0) for i in range(7)], "station long, x double, y double, z double, tx double, ty double, tz double")
    slabs = t.station_slabs(p, s, 0.2, 0.05)
    assert slabs.groupBy("station").count().agg({"count": "min"}).first()[0] >= 30 and slabs.agg(F.max(F.abs("axial"))).first()[0] <= 0.05
    moved = t.recenter(s, slabs).collect()
    assert max(abs(r["x"]) + abs(r["y"]) for r in moved) < 0.03 and len(moved) == 7


def test_copies_and_medoids(spark):
    line = "candidate_id long, node_id long, x double, y double, z double, tx double, ty double, tz double"
    parents = spark.createDataFrame([(0, i, 0.0, 0.0, 0.1 * i, 0.0, 0.0, 1.0) for i in range(20)], line)
    c = spark.createDataFrame([(1, i, 0.05, 0.0, 0.1 * i, 0.0, 0.0, -1.0) for i in range(10)] + [(2, i, 0.05 + 0.2 * i, 0.0, 0.5, 1.0, 0.0, 0.0) for i in range(10)], line)
    got = {r["candidate_id"]: r["copy"] for r in t.tracking_copies(c, parents, 0.01).collect()}
    assert got == {1: True, 2: False}
    v = spark.createDataFrame([("s", 1, 0.01, 0.0, 0.0, 1.0), ("s", 2, 0.02, 0.0, 0.0, 3.0), ("s", 3, 5.0, 0.0, 0.0, 0.5)], "start string, variant_id long, x double, y double, z double, score double")
    assert {(r["variant_id"], r["members"]) for r in t.medoids(v, ["start"], 0.1).collect()} == {(2, 2), (3, 1)}


def test_limits_regions_and_times(spark):
    r = spark.createDataFrame([("p", 0, 0.01), ("p", 1, 0.02)], "root string, node_id long, radius double")
    assert [round(x["near"], 4) for x in t.seed_limits(r, 0.001, ["root"]).orderBy("node_id").collect()] == [0.019, 0.029]
    nodes = spark.createDataFrame([("s", "a", i, 0.0, 0.0, 0.0) for i in range(3)], "sample_id string, root_id string, node_id int, x double, y double, z double")
    roots = spark.createDataFrame([("s", "a", 1, None)], "sample_id string, root_id string, body_start_index int, qc_flags array<string>")
    assert [x["region"] for x in t.skeleton_regions(nodes, roots).orderBy("node_id").collect()] == ["parent_connector", "exposed_body", "exposed_body"]
    runs = spark.createDataFrame([("load", i, float(i)) for i in range(60)], "step string, ended_at long, seconds double")
    assert tuple(t.step_times(runs).first()) == ("load", 34.5, 50)


def test_traits_and_nodules(spark):
    nodes = spark.createDataFrame([(1, i, 0.0, 0.0, float(i), 0.5) for i in range(3)], "root_id long, node_id long, x double, y double, z double, radius double")
    roots = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 1, True)], "root_id long, root_order int, excluded boolean")
    support = spark.createDataFrame([(1, 0.5)], "root_id long, supported double")
    got = {r["root_id"]: r for r in t.root_traits(nodes, roots, support, 10.0).collect()}
    assert got[1]["length"] == 20 and got[1]["volume"] == pytest.approx(math.pi * 25 * 20) and got[1]["mean_diameter"] == 10
    assert [got[i]["length_measurement_status"] for i in (1, 2, 3)] == ["partial", "unavailable", "excluded"] and got[2]["length"] is None
    patches = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0), (1, 2, 4.0, 0.0, 0.0, 3.0)], "nodule_id int, id long, x double, y double, z double, weight double")
    contacts = spark.createDataFrame([(1, 5)] * 7 + [(1, 6)] * 3, "nodule_id int, label int")
    r = t.nodule_quantities(patches, contacts).first()
    assert r["cx"] == 3 and r["area"] == 4 and r["root"] == 5
    labels = spark.createDataFrame([(1, 0), (2, 0)], "id long, label int")
    assert dict(map(tuple, t.reassign(labels, labels.filter("id = 2").withColumn("label", F.lit(9))).collect())) == {1: 0, 2: 9}
