import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborline.functions import geometry as g
from arborline.functions import text as tx
from arborline.operators import architecture as arch
from arborline.operators import mesh, polyline, spatial
from arborline.operators.graph import components

V = "id long, x double, y double, z double, label int"


def line(spark, points, root=1):
    return spark.createDataFrame([(root, i, *map(float, p)) for i, p in enumerate(points)], "root_id long, node_id long, x double, y double, z double")


CORNERS = [(1.0, 1.0, 0.0), (4.0, 1.0, 1.0), (2.0, 5.0, 0.5), (1.5, 2.0, 6.0)]
SIDES = ((0, 1, 3), (1, 2, 3), (2, 0, 3), (0, 2, 1))
VOLUME = abs(np.linalg.det(np.diff([CORNERS[i] for i in (3, 0, 1, 2)], axis=0))) / 6
AREA = sum(np.linalg.norm(np.cross(*(np.subtract(CORNERS[t[k]], CORNERS[t[0]]) for k in (1, 2)))) / 2 for t in SIDES)


def tetrahedron(spark, faces=SIDES, shift=0.0):
    v = [(i, p[0] + shift, p[1] + shift, p[2] + shift, i % 2) for i, p in enumerate(CORNERS)]
    return spark.createDataFrame(list(faces), "a long, b long, c long"), spark.createDataFrame(v, V)


def test_angles(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, -1.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "ax double, ay double, az double, bx double, by double, bz double")
    got = df.select(g.directed_angle(g.xyz("a"), g.xyz("b")).alias("d"), g.axial_angle(g.xyz("a"), g.xyz("b")).alias("a")).collect()
    assert got[0]["d"] == pytest.approx(135) and got[0]["a"] == pytest.approx(45) and got[1]["d"] is None


def test_lengths_resampling_projection(spark):
    df = line(spark, [(0, 0, 0), (0, 0, 1)])
    assert [(r["number"], r["z"]) for r in polyline.resample(df, 0.25).orderBy("number").collect()] == [(i, pytest.approx(i / 4)) for i in range(5)]
    bent = line(spark, [(0, 0, 0), (3, 0, 0), (3, 4, 0)]).union(line(spark, [(1, 1, 1)], 2))
    r = {x["root_id"]: x for x in polyline.lengths(bent).collect()}
    assert r[1]["length"] == 7 and r[1]["chord"] == 5 and r[1]["tortuosity"] == 1.4 and r[2]["length"] == 0 and r[2]["tortuosity"] is None
    points = spark.createDataFrame([(1, 0, 1.0, 2.0, 0.0), (1, 1, 9.0, 9.0, 0.0)], "root_id long, point_id long, x double, y double, z double")
    p = {x["point_id"]: x for x in polyline.project(points, bent).collect()}
    assert p[0]["arc"] == 1 and p[0]["distance"] == 2 and p[1]["arc"] == 7
    t = {x["node_id"]: x for x in polyline.tangents(bent.filter("root_id = 1")).collect()}
    assert (t[0]["tx"], t[2]["ty"]) == (1, 1) and t[1]["tx"] == pytest.approx(0.6)
    w = polyline.arc_window(bent, 1.0).collect()
    assert len(w) == 1 and w[0]["wy"] == pytest.approx(1)


def test_frusta_fill_and_intervals(spark):
    df = line(spark, [(0, 0, 0), (0, 0, 2), (0, 0, 4)]).withColumn("radius", F.when(F.col("node_id") < 2, 1.0))
    r = polyline.frusta(df).first()
    assert r["volume"] == pytest.approx(2 * math.pi) and r["lateral_area"] == pytest.approx(4 * math.pi)
    gaps = spark.createDataFrame([(1, 0.0, None), (1, 1.0, 2.0), (1, 2.0, None), (1, 4.0, 8.0), (1, 5.0, None)], "root_id long, p double, v double")
    assert [x["v"] for x in polyline.fill_linear(gaps, "v", "p").orderBy("p").collect()] == [2, 2, 4, 8, 8]
    spans = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 0.5, 0.6), (1, 3.0, 4.0), (1, 5.0, 4.0), (1, None, 1.0)], "root_id long, low double, high double")
    assert sorted((x["low"], x["high"], x["parts"]) for x in polyline.merge_intervals(spans).collect()) == [(0, 2, 3), (3, 4, 1)]


def test_closed_and_open_tetrahedron(spark):
    f, v = tetrahedron(spark)
    a = mesh.audit(f, v).first()
    assert abs(a["signed_volume"]) == pytest.approx(VOLUME) and a["area"] == pytest.approx(AREA) and a["closed"]
    assert mesh.origin_sensitivity(f, v).first()["spread"] == pytest.approx(0, abs=1e-12)
    o, _ = tetrahedron(spark, [t for t in SIDES if t != (1, 2, 3)])
    b = mesh.audit(o, v).first()
    assert b["boundary_edges"] == 3 and not b["closed"] and mesh.origin_sensitivity(o, v).first()["spread"] > 0
    far, w = tetrahedron(spark, shift=1e6)
    assert mesh.component_volumes(far, w).first()["volume"] == pytest.approx(VOLUME, rel=1e-9)
    empty = f.limit(0)
    assert mesh.audit(empty, v).first()["faces"] == 0 and not mesh.audit(empty, v).first()["closed"]


def test_owners_duplicates_and_weights(spark):
    f, v = tetrahedron(spark)
    total = AREA
    for mode in ("majority", "thirds"):
        assert sum(r["area"] for r in mesh.surface_by_owner(f, v, mode).collect()) == pytest.approx(total)
    assert sum(r["weight"] for r in mesh.vertex_weights(f, v).collect()) == pytest.approx(total)
    double = f.union(spark.createDataFrame([(1, 0, 2), (0, 0, 1)], "a long, b long, c long"))
    assert [tuple(r) for r in mesh.duplicate_faces(double).collect()] == [(0, 1, 2, 2)]
    assert mesh.contact_edges(f, v).first()["edges"] == 4
    bad = v.withColumn("z", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("z")))
    assert [tuple(r) for r in mesh.sanitize(f, bad).collect()] == [(0, 2, 1)]


def test_seams(spark):
    soup = spark.createDataFrame([(3 * k, 3 * k + 1, 3 * k + 2) for k in range(4)], "a long, b long, c long")
    corners = [CORNERS[i] for t in SIDES for i in t]
    v = spark.createDataFrame([(i, *c, 0) for i, c in enumerate(corners)], V)
    assert mesh.seam_index(soup, v).select("representative").distinct().count() == 4
    assert mesh.seam_index(soup.filter("a > 0"), v).filter("id <> representative").count() == 2  # only the corner that is still closed all around


def brute_pairs(p, radius):
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    return {(i, j) for i in range(len(p)) for j in range(len(p)) if i != j and d[i, j] <= radius}


def test_grid_joins_against_brute_force(spark):
    p = np.random.default_rng(3).normal(size=(120, 3))
    p[5] = p[6]
    df = spark.createDataFrame([(i, *map(float, q), i % 3) for i, q in enumerate(p)], V)
    pairs = spatial.within(df.withColumnRenamed("id", "a_id"), df.withColumnRenamed("id", "b_id"), 0.4).filter("a_id <> b_id")
    assert {(r["a_id"], r["b_id"]) for r in pairs.collect()} == brute_pairs(p, 0.4)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(p)) for j in np.lexsort((np.arange(len(p)), d[i]))[:3]}
    assert {(r["a_id"], r["b_id"]) for r in spatial.knn(df, 3).collect()} == want
    assert spatial.mean_nearest_distance(df).first()["mean_distance"] == pytest.approx(d.min(1).mean())


def test_two_owners(spark):
    points = spark.createDataFrame([(0, 0.0, 0.1, 0.0), (1, 0.0, 5.0, 0.0)], "id long, x double, y double, z double")
    pieces = spark.createDataFrame([(1, 0, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0), (2, 0, -9.0, 0.25, 0.0, 9.0, 0.25, 0.0)], "owner int, seg_id long, ax double, ay double, az double, bx double, by double, bz double")
    got = spatial.assign(spatial.nearest_two_owners(points, pieces, 0.5), 0.04).collect()
    assert [tuple(r) for r in got] == [(0, 1, pytest.approx(0.1), 2, pytest.approx(0.15), 1)]
    assert spatial.assign(spatial.nearest_two_owners(points, pieces, 0.5), 0.06).first()["label"] == -2


def test_owners_have_all_vertices(spark, tmp_path):
    """Against all segments between all consecutive vertices of a label."""
    from arborline.plans.catalogue import assignment_summary, nearest_two_owners

    rng = np.random.default_rng(4)
    p, label = rng.random((80, 3)) * 0.8, rng.integers(0, 5, 80)
    spark.createDataFrame([(i, [float(x) for x in q], int(l)) for i, (q, l) in enumerate(zip(p, label))], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want, labels = {}, []
    for i, q in enumerate(p):
        best = {}
        for o in range(5):
            at = p[label == o]
            for a, b in zip(at, at[1:]):
                t = np.clip(np.dot(q - a, b - a) / np.dot(b - a, b - a), 0, 1)
                best[o] = min(best.get(o, 9.0), float(np.linalg.norm(q - a - t * (b - a))))
        near = sorted((d, o) for o, d in best.items() if d <= 0.15)[:2]
        state = -1 if not near else -2 if len(near) == 2 and near[1][0] - near[0][0] <= 0.02 else near[0][1]
        labels.append(state)
        if near:
            want[i] = (*near[0][::-1], *(near[1][::-1] if len(near) == 2 else (None, None)), state)
    got = {r["id"]: (r["owner"], r["distance"], r["rival"], r["rival_distance"], r["label"]) for r in nearest_two_owners(spark, str(tmp_path)).collect()}
    # A vertex on its own polyline is at 0 but for the squares' rounding.
    assert got == {i: pytest.approx(w, abs=2e-6) for i, w in want.items()}
    assert tuple(assignment_summary(spark, str(tmp_path)).first()) == (80, labels.count(0), sum(x > 0 for x in labels), labels.count(-1), labels.count(-2), 0)


def test_unit_box(spark):
    v = spark.createDataFrame([(0, 2.0, 4.0, 10.0), (1, 4.0, 8.0, 14.0), (2, 6.0, 6.0, 18.0)], "id long, x double, y double, z double")
    assert spatial.unit_box(v).agg(F.max("z")).first()[0] == 1
    assert spatial.unit_box(v.filter("id = 0")).first()["x"] is None


def test_components(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(e, "u long, v long"), spark.createDataFrame([(300,)], "id long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100 and got[200] == 200 and got[300] == 300
    star = spark.createDataFrame([(0, i) for i in range(1, 300)], "u long, v long")
    assert components(star).select("component").distinct().count() == 1


def traits(spark):
    nan = float("nan")
    rows = [("primary", None, 0, 10.0), ("a", "primary", 1, 8.0), ("b", "primary", 1, 6.0), ("c", "a", 2, 3.0), ("d", "a", 2, 2.0), ("missing", "a", 2, nan), ("zero", "a", 2, 0.0)]
    return spark.createDataFrame([("s", r, p, o, l, l is not None and l == l and l > 0, "complete" if l and l == l else "unavailable", (l or 0) / 2 if l and l == l else None, True, "complete", 1.0) for r, p, o, l in rows],
        "sample_id string, root_id string, parent_id string, root_order int, length double, length_measurement_eligible boolean, length_measurement_status string, mean_diameter double, mean_diameter_measurement_eligible boolean, mean_diameter_measurement_status string, volume double")


def test_architecture(spark):
    t = traits(spark)
    s = {r["scope"]: r for r in arch.scope_summary(t, ["sample_id"]).collect()}
    assert s["system"]["eligible_roots"] == 5 and s["system"]["excluded_roots"] == 2 and s["system"]["total_length"] == 29
    assert s["order_2"]["diameter_p50"] == 1.25 and s["order_2"]["diameter_p10"] == pytest.approx(1.05)
    l = t.filter(arch.eligible("length").isNotNull()).select("sample_id", "parent_id", F.lit(True).alias("ok")).filter("parent_id is not null")
    p = t.select("sample_id", "root_id", arch.eligible("length").alias("length"))
    assert arch.branch_density(l, p, ["sample_id"]).first()["density"] == pytest.approx(4 / 18)
    lost = p.withColumn("length", F.when(F.col("root_id") != "a", F.col("length")))
    r = arch.branch_density(l, lost, ["sample_id"]).first()
    assert r["unusable_parents"] == 1 and r["density"] is None
    assert arch.scope_summary(t.limit(0), ["sample_id"]).count() == 0


def test_branch_gaps(spark):
    b = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 2.0), ("p", "c", 6.0), ("q", "d", 1.0), ("q", "e", None), ("q", "f", float("nan"))], "parent string, root_id string, arc double")
    r = {x["parent"]: x for x in arch.branch_gaps(b, ["parent"]).collect()}
    assert r["p"]["mean_gap"] == 2 and r["p"]["coincident"] == 1 and r["q"]["gaps"] == 0 and r["q"]["mean_gap"] is None
    assert {x["parent"]: x for x in arch.branch_gaps(b, ["parent"], True).collect()}["p"]["mean_gap"] == 4


def test_texts(spark):
    df = spark.createDataFrame([("a; b;a;;c", [1.0, -0.0], '{"user": "x", "api_token": "s3", "n": 1, "Password": 5}')], "f string, v array<double>, c string")
    r = df.select(tx.join_flags(tx.edit_flags(tx.split_flags(F.col("f")), F.array(F.lit("b")), F.array(F.lit("z")))).alias("f"), tx.fingerprint(F.col("v")).alias("p"), tx.redact(F.col("c")).alias("c")).first()
    assert r["f"] == "a;c;z" and "s3" not in r["c"] and ": 5" not in r["c"] and '"n": 1' in r["c"]
    same = spark.createDataFrame([([1.0, 0.0],)], "v array<double>").select(tx.fingerprint(F.col("v"))).first()[0]
    assert r["p"] == same
