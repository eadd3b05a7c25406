import numpy as np
import pytest

from arborline.sources import files, formats

# A skew wedge: a square pyramid without its base.
P = np.array([[1.5, 0.25, 5.0], [-1.0, -1.0, 0.5], [1.0, -1.25, 0.0], [1.25, 1.0, -0.5], [-0.75, 1.5, 0.25]])
F4 = np.array([[0, 1, 2], [0, 2, 3], [0, 3, 4], [0, 4, 1]])


def test_round_trips():
    g = formats.Geometry(P, F4, {"label": np.array([0, 3, -1, -2, 7])})
    back = formats.read_ply(formats.write_ply(g))
    assert np.array_equal(back.points, P) and np.array_equal(back.faces, F4) and back.extra["label"].tolist() == [0, 3, -1, -2, 7]
    stl = formats.write_stl(g, "units=cm")
    assert formats.is_binary_stl(stl) and formats.header_text(stl) == "units=cm"
    soup = formats.read_stl(stl)
    assert np.allclose(soup.points, P[F4].reshape(-1, 3)) and len(soup.faces) == 4


def test_text_formats():
    ascii_stl = b"solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid"
    assert len(formats.read_stl(ascii_stl).faces) == 1
    ply = b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    assert formats.read_ply(ply).faces.tolist() == [[0, 1, 2], [0, 2, 3]]
    obj = b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 -1\n"
    assert formats.read_obj(obj).faces.tolist() == [[0, 1, 2]]
    assert formats.read_off(b"OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n").faces.tolist() == [[0, 1, 2]]
    assert formats.read_points(b"a,X,y,Z\n9,1,2,3\nbad,x,,\n").points.tolist() == [[1, 2, 3]]
    assert formats.read_points(b"1 2 3 255\nx\n4,5,6\n").points.tolist() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(ValueError):
        formats.read("x.fbx", b"")


def test_folder(spark, tmp_path):
    g = formats.Geometry(P, F4)
    (tmp_path / "one.ply").write_bytes(formats.write_ply(g))
    (tmp_path / "two.stl").write_bytes(formats.write_stl(g, "exporter; Units: Inch."))
    (tmp_path / "bad.ply").write_bytes(b"nothing")
    (tmp_path / "empty.xyz").write_bytes(b"")
    v, f = files.read_geometry(spark, str(tmp_path))
    assert {r["sample_id"]: r["count"] for r in v.groupBy("sample_id").count().collect()} == {"one": 5, "two": 12}
    assert f.count() == 8 and files.unreadable(spark, str(tmp_path)).count() == 1
    assert [tuple(r) for r in files.declared_units(spark, str(tmp_path)).select("sample_id", "mm_per_unit").collect()] == [("two", 25.4)]
    assert files.check_mode("auto", f) == "triangle_mesh" and files.check_mode("auto", f.limit(0)) == "surface_points"
    with pytest.raises(ValueError):
        files.check_mode("surface_points", f)
    assert files.provenance(spark, str(tmp_path), {"a": 1}).count() == 3


def test_data_source(spark, tmp_path):
    (tmp_path / "one.ply").write_bytes(formats.write_ply(formats.Geometry(P, F4)))
    spark.dataSource.register(files.GeometrySource)
    assert spark.read.format("geometry").load(str(tmp_path)).count() == 5
    assert spark.read.format("geometry").option("part", "faces").load(str(tmp_path)).count() == 4


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("s", i, *map(float, p), i) for i, p in enumerate(P)], "sample_id string, vertex_id long, x double, y double, z double, label int")
    f = spark.createDataFrame([("s", i, *map(int, t)) for i, t in enumerate(F4)], "sample_id string, face_id long, a long, b long, c long")
    out = files.write_files(files.ply_files(v, f), str(tmp_path / "ply"), "ply").collect()
    assert formats.read_ply(open(out[0]["path"], "rb").read()).faces.tolist() == F4.tolist()
    roots = spark.createDataFrame([("s", "primary", None, 0, float("nan"), ["q"]), ("s", "a<1>", "primary", 1, 0.5, [])], "sample_id string, root_id string, parent_id string, root_order int, confidence double, qc_flags array<string>")
    nodes = spark.createDataFrame([("s", "primary", 1, 0.0, 0.0, 1e-7), ("s", "primary", 0, 0.0, 0.0, 1.0)], "sample_id string, root_id string, node_id long, x double, y double, z double")
    xml = bytes(files.rsml_files(roots, nodes).first()["content"]).decode()
    assert xml.index('id="primary"') < xml.index('id="a&lt;1&gt;"') and "0.0000001" in xml and xml.count("</root>") == 2
    import xml.etree.ElementTree as E

    E.fromstring(xml)
    assert '"confidence":null' in files.hierarchy_json(roots).filter("root_id = 'primary'").first()["document"]
    files.write_bundle({"roots": roots}, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle/roots.parquet")).count() == 2
    with pytest.raises(Exception):
        files.write_bundle({"roots": roots}, str(tmp_path / "bundle"))


def test_a_file_in_pieces(spark):
    shifted = {"s": 10, "t": 100, None: 1000}  # ids with gaps
    v = spark.createDataFrame([(s, i * k, *map(float, p), None if i == 2 else i) for s, k in shifted.items() for i, p in enumerate(P)], "sample_id string, vertex_id long, x double, y double, z double, label int")
    lost = (0, 1, 77)
    f = spark.createDataFrame([(s, -i, *(int(c) * k for c in t)) for s, k in shifted.items() for i, t in enumerate([*F4, lost])], "sample_id string, face_id long, a long, b long, c long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        pieces = files.ply_pieces(v, f).localCheckpoint()
        assert pieces.agg({"rows": "max"}).first()[0] <= 2 and pieces.filter("sample_id = 's' and element = 2").count() > 1
        whole = formats.write_ply(formats.Geometry(P, F4[::-1], {"label": np.array([0, 1, -1, 3, 4])}))
        assert {r["sample_id"]: bytes(r["content"]) for r in files.ply_files(v, f).collect()} == dict.fromkeys(shifted, whole)
        got = sorted(map(tuple, files.decode_pieces(pieces.filter("sample_id = 't'"), "faces").collect()))
        assert got == [("t", i, *map(int, t)) for i, t in enumerate(F4[::-1])]
        last = "element = 2 and piece = (select max(piece) from pieces where sample_id = 's')"
        pieces.createOrReplaceTempView("pieces")
        for broken in (pieces.filter(f"not (sample_id <=> 's' and {last})"), pieces.selectExpr("sample_id", "element", "piece", "rows", f"case when sample_id <=> 's' and {last} then content || X'00' else content end as content")):
            back = files.decode_pieces(broken, "vertices", scalars=True).collect()
            assert sorted((str(r["sample_id"]), r["vertex_id"], r["x"], r["scalars"]["label"]) for r in back) == [(s, i, P[i][0], [0, 1, -1, 3, 4][i]) for s in ("None", "t") for i in range(5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert files.decode_pieces(files.ply_pieces(v.limit(0), f), "vertices").count() == 0


def test_lists_of_one_length_and_of_several():
    head = b"ply\nformat binary_little_endian 1.0\nelement face 2\nproperty list uchar int vertex_index\nend_header\n"
    row = lambda *c: bytes([len(c)]) + np.array(c, "<i4").tobytes()
    assert formats.read_ply(head + row(0, 1, 2, 3) + row(4, 5, 6, 7)).faces.tolist() == [[0, 1, 2], [0, 2, 3], [4, 5, 6], [4, 6, 7]]
    assert formats.read_ply(head + row(0, 1) + row(4, 5)).faces.tolist() == []
    assert formats.read_ply(head + row(0, 1, 2, 3) + row(4, 5, 6)).faces.tolist() == [[0, 1, 2], [0, 2, 3], [4, 5, 6]]


def test_synthetic(spark):
    t = files.synthetic_taproot(spark)
    assert t.count() == 420 and t.filter("root = 0").count() == 180 and t.agg({"z": "max"}).first()[0] < 1.1


def test_guides(spark):
    from arborline.sources import guides

    want = {"start": (0.0, 0.0, 1.0), "end": (0.0, 0.0, 0.0)}
    for text in ('{"start": [0, 0, 1], "end": [0, 0, 0]}', "name,x,y,z\nstart,0,0,1\nend,0,0,0\n", "0 0 1, 0 0 0"):
        assert guides.read_endpoints(text) == want
    for text in ("1 2 3", "0 0 0 0 0 0", "name,x,y,z\nstart,0,0,1\n"):
        with pytest.raises(ValueError):
            guides.read_endpoints(text)
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "id long, label int")
    reviewed = spark.createDataFrame([(i, 5) for i in range(99, 199)], "id long, label int")
    assert guides.apply_reviewed_labels(labels, reviewed.filter("id = 99"), "f", "f").filter("label = 5").count() == 1
    for a, b in (("f", "g"), ("f", "f")):
        with pytest.raises(ValueError):
            guides.apply_reviewed_labels(labels, reviewed, a, b)
    objects = spark.createDataFrame([(1, "f"), (2, "g"), (3, "h")], "object_id int, fingerprint string")
    reviews = spark.createDataFrame([(1, "f", False), (1, "f", True), (2, "old", False), (9, "x", True)], "object_id int, fingerprint string, accepted boolean")
    kept, refused = guides.apply_reviews(objects, reviews)
    assert {r["object_id"] for r in kept.collect()} == {2, 3} and {tuple(r) for r in refused.collect()} == {(2, "stale"), (9, "unknown")}
