"""Geometry files as tables, and tables as files.

A folder of files is read by ``binaryFile`` and decoded file by file where it lies; one file is the least unit, as its
bytes cannot be cut. Files that cannot be decoded give no rows but an entry in ``unreadable``. PLY files made here also come
in pieces of whole rows (``ply_pieces``, ``decode_pieces``), so that no task holds a file.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arborline.common import finite, partitions, running, stored
from arborline.operators.units import declared_word, unit_factor
from arborline.sources import formats

VERTICES = "sample_id string, vertex_id long, x double, y double, z double"
FACES = "sample_id string, face_id long, a long, b long, c long"
PIECES = "sample_id string, element int, piece long, rows long, content binary"

#: Rows handed over at a time.
CHUNK = 100_000


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``sample_id, path, content`` of the files of a folder; the sample is the name without its suffix. Empty files are not seen."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("sample_id"), "path", "content")


def _rows(g: formats.Geometry, sample: str, part: str, scalars: bool = False, first: int = 0) -> Iterator[pd.DataFrame]:
    values, names = (g.points, ["x", "y", "z"]) if part == "vertices" else (g.faces, ["a", "b", "c"])
    for k in range(0, len(values), CHUNK):
        v = values[k : k + CHUNK]
        more = {"scalars": [dict(zip(g.extra, map(float, x))) for x in zip(*(c[k : k + CHUNK] for c in g.extra.values()))] if g.extra else [{}] * len(v)} if scalars else {}
        yield pd.DataFrame({"sample_id": sample, "vertex_id" if part == "vertices" else "face_id": np.arange(first + k, first + k + len(v)), **{c: v[:, i] for i, c in enumerate(names)}, **more})


def _schema(part: str, scalars: bool) -> str:
    return (VERTICES + (", scalars map<string,double>" if scalars else "")) if part == "vertices" else FACES


def decode(files: DataFrame, part: str, scalars: bool = False) -> DataFrame:
    """The vertices or faces of files (sample_id, path, content); with ``scalars``, vertices have a map of the file's further columns (labels).

    Files that cannot be decoded give no rows; ``unreadable`` names them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data, sample in zip(batch["path"], batch["content"], batch["sample_id"]):
                try:
                    yield from _rows(formats.read(name, bytes(data)), sample, part, scalars)
                except (ValueError, KeyError, IndexError):
                    continue

    return files.mapInPandas(run, _schema(part, scalars))


def read_geometry(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of all files of a folder."""
    files = raw_files(spark, path, pattern)
    return decode(files, "vertices"), decode(files, "faces")


def read_labelled(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Vertices of all files of a folder with their further columns: sample_id, vertex_id, x, y, z, scalars."""
    return decode(raw_files(spark, path, pattern), "vertices", scalars=True)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """``path, reason`` of the files that cannot be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    formats.read(name, bytes(data))
                except (ValueError, KeyError, IndexError) as e:
                    out.append((name, str(e)))
            yield pd.DataFrame(out, columns=["path", "reason"])

    return raw_files(spark, path).mapInPandas(run, "path string, reason string")


def declared_units(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, declaration, mm_per_unit`` of binary STL files whose header names a unit."""
    f = raw_files(spark, path, "*.[sS][tT][lL]")
    n = F.conv(F.hex(F.reverse(F.expr("substring(content, 81, 4)"))), 16, 10).cast("long")
    body = f.filter(F.length("content") == 84 + 50 * n)
    head = F.trim(F.translate(F.decode(F.expr("substring(content, 1, 80)"), "ISO-8859-1"), "\0", ""))
    return body.select("sample_id", head.alias("declaration")).select("sample_id", "declaration", unit_factor(declared_word(F.col("declaration"))).alias("mm_per_unit")).filter("mm_per_unit is not null")


def check_mode(mode: str, faces: DataFrame) -> str:
    """The way a geometry is read: auto becomes triangle_mesh or surface_points; a mode that the faces contradict is an error."""
    has = not faces.isEmpty()
    if mode == "auto":
        return "triangle_mesh" if has else "surface_points"
    if mode not in ("triangle_mesh", "surface_points", "occupied_volume"):
        raise ValueError(f"unknown mode {mode}")
    if (mode == "triangle_mesh") != has:
        raise ValueError("mesh mode needs faces, point modes must not have any")
    return mode


class GeometrySource(DataSource):
    """``spark.read.format("geometry").option("part", "vertices" or "faces").load(folder)``; register it with the session first."""

    @classmethod
    def name(cls) -> str:
        return "geometry"

    def schema(self) -> str:
        return VERTICES if self.options.get("part", "vertices") == "vertices" else FACES

    def reader(self, schema) -> DataSourceReader:
        return _GeometryReader(self.options["path"], self.options.get("part", "vertices"))


class _GeometryReader(DataSourceReader):
    def __init__(self, path: str, part: str) -> None:
        self.path, self.part = path, part

    def partitions(self) -> list[InputPartition]:
        known = {*formats.MESH_SUFFIXES, *formats.POINT_SUFFIXES}
        return [InputPartition(p) for p in sorted(os.path.join(r, f) for r, _, fs in os.walk(self.path) for f in fs) if p.rpartition(".")[2].lower() in known]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        with open(path, "rb") as f:
            for part in _rows(formats.read(path, f.read()), os.path.splitext(os.path.basename(path))[0], self.part):
                yield from part.itertuples(index=False, name=None)


def synthetic_taproot(spark: SparkSession, axis: int = 180, laterals: int = 3, per_lateral: int = 80, noise: float = 0.004, seed: int = 21) -> DataFrame:
    """A main axis from z = 1 to 0 and oblique branches with Gaussian noise: vertex_id, root, x, y, z."""
    rows = spark.range(axis + laterals * per_lateral).withColumn("root", F.when(F.col("id") < axis, 0).otherwise((1 + F.floor((F.col("id") - axis) / per_lateral)).cast("int")))
    along = F.when(F.col("root") == 0, F.col("id") / (axis - 1)).otherwise(F.pmod(F.col("id") - axis, F.lit(per_lateral)) / (per_lateral - 1))
    turn, z0 = F.col("root") * 2.399, 0.85 - 0.2 * (F.col("root") - 1)
    main = F.col("root") == 0
    at = {"x": F.when(main, 0.0).otherwise(0.35 * along * F.cos(turn)), "y": F.when(main, 0.0).otherwise(0.35 * along * F.sin(turn)), "z": F.when(main, 1.0 - along).otherwise(z0 - 0.2 * along)}
    return rows.select(F.col("id").alias("vertex_id"), F.col("root").cast("int").alias("root"), *((c + F.lit(noise) * F.randn(seed + k)).alias(a) for k, (a, c) in enumerate(at.items())))


def ply_pieces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One labelled PLY file per sample, in pieces of whole rows: sample_id, element, piece, rows, content.

    In the order of (element, piece) the pieces of a sample are the bytes of its file; element 0 is the header, 1 the
    vertices by id, 2 the faces by id. ``vertices``: sample_id, vertex_id (unique in a sample), x, y, z, label; ``faces``:
    sample_id, face_id, a, b, c (ids; faces with a corner that is not there are left out). No task holds a sample.
    """
    n = partitions(vertices.sparkSession)
    v = vertices.select("sample_id", "vertex_id", "x", "y", "z", F.coalesce("label", F.lit(-1)).alias("label"), F.lit(1).alias("one"))
    v = stored(running(v, ["sample_id"], [F.col("vertex_id").asc_nulls_last()], "one", "place").withColumn("place", F.col("place") - 1).drop("one"))
    f = faces.select("sample_id", "face_id", "a", "b", "c")
    for c in "abc":
        at = v.select(F.col("sample_id").alias("_sample"), F.col("vertex_id").alias("_id"), F.col("place").alias(f"_{c}"))
        f = f.join(at, F.col("sample_id").eqNullSafe(F.col("_sample")) & (F.col(c) == F.col("_id"))).drop("_sample", "_id", c)

    def packed(rows: DataFrame, by: str, element: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            piece = TaskContext.get().partitionId() << 32
            for batch in batches:
                for sample, own in batch.groupby("sample_id", sort=False, dropna=False):
                    for k in range(0, len(own), CHUNK):
                        t = own.iloc[k : k + CHUNK]
                        content = formats.ply_vertices(t[["x", "y", "z"]].to_numpy(), {"label": t["label"].to_numpy()}) if element == 1 else formats.ply_faces(t[["_a", "_b", "_c"]].to_numpy())
                        yield pd.DataFrame({"sample_id": [None if pd.isna(sample) else sample], "element": [element], "piece": [piece], "rows": [len(t)], "content": [content]})
                        piece += 1

        order = ["sample_id", F.col(by).asc_nulls_last()]
        return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(run, PIECES)

    body = stored(packed(v, "place", 1).unionByName(packed(f, "face_id", 2)))
    rows = lambda k: F.sum(F.when(F.col("element") == k, F.col("rows")).otherwise(0))
    text = F.format_string(formats.ply_head("%d", "%d", ["label"]).decode(), rows(1), rows(2))
    head = body.groupBy("sample_id").agg(F.encode(text, "UTF-8").alias("content"))
    return head.select("sample_id", F.lit(0).alias("element"), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("rows"), "content").unionByName(body)


def decode_pieces(pieces: DataFrame, part: str, scalars: bool = False) -> DataFrame:
    """The vertices or faces of files in pieces (``ply_pieces``), as ``decode`` gives them.

    All pieces are read, each by the header of its file. A file of which a piece cannot be read, or that has more or fewer
    rows than its header says, gives no rows.
    """
    wanted = 1 if part == "vertices" else 2
    head = stored(pieces.filter("element = 0").select(F.col("sample_id").alias("_sample"), F.col("content").alias("head")))
    held = pieces.join(head, F.col("sample_id").eqNullSafe(F.col("_sample"))).drop("_sample")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sample, element, piece, rows, content, top in zip(*(batch[c] for c in ("sample_id", "element", "piece", "rows", "content", "head"))):
                try:
                    if element == 0:
                        out += [(sample, k, -1, -n) for k, n in enumerate(formats.ply_counts(bytes(top)), 1)]
                    else:
                        g = formats.read_ply_piece(bytes(top), element, rows, bytes(content))
                        out.append((sample, element, piece, len(g.points) + len(g.faces)))
                except (ValueError, KeyError, IndexError):
                    out.append((sample, element, piece, None))
            yield pd.DataFrame(out, columns=["sample_id", "element", "piece", "rows"]).astype({"rows": "Int64"})

    found = stored(held.mapInPandas(read, "sample_id string, element int, piece long, rows long"))
    bad = found.groupBy("sample_id", "element").agg(F.sum("rows").alias("n"), F.count(F.when(F.col("rows").isNull(), 1)).alias("unread")).filter("n <> 0 or unread > 0").select(F.col("sample_id").alias("_sample"))
    w = W.partitionBy("sample_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    own = found.filter((F.col("element") == wanted) & (F.col("piece") >= 0)).select("sample_id", "piece", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("first"))
    whole = stored(own.join(bad, F.col("sample_id").eqNullSafe(F.col("_sample")), "left_anti").select(F.col("sample_id").alias("_sample"), F.col("piece").alias("_piece"), "first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample, rows, content, top, first in zip(*(batch[c] for c in ("sample_id", "rows", "content", "head", "first"))):
                yield from _rows(formats.read_ply_piece(bytes(top), wanted, rows, bytes(content)), sample, part, scalars, first)

    return held.filter(F.col("element") == wanted).join(whole, F.col("sample_id").eqNullSafe(F.col("_sample")) & (F.col("piece") == F.col("_piece"))).drop("_sample", "_piece").mapInPandas(run, _schema(part, scalars))


def ply_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The files of ``ply_pieces`` as one row each: sample_id, content; a file must fit a task."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "content": [b"".join(map(bytes, pdf.sort_values(["element", "piece"])["content"]))]})

    return ply_pieces(vertices, faces).groupBy("sample_id").applyInPandas(join, "sample_id string, content binary")


def _number(value: float) -> str:
    return np.format_float_positional(float(value), trim="-")


def rsml_files(roots: DataFrame, nodes: DataFrame, properties: tuple[str, ...] = ()) -> DataFrame:
    """One RSML document per sample: sample_id, content. Roots nest by parent; ``nodes``: sample_id, root_id, node_id, x, y, z.

    ``properties``: columns of ``roots`` that become properties of a root (missing values are left out). A column ``radius``
    of the nodes becomes a function ``diameter`` along the polyline. Roots on circles have no place in a document.
    """
    radius = F.col("radius") if "radius" in nodes.columns else F.lit(None).cast("double")
    lines = nodes.groupBy("sample_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "x", "y", "z", radius.alias("r")))).alias("line"))
    rows = roots.select("sample_id", "root_id", "parent_id", *properties).join(lines, ["sample_id", "root_id"], "left")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        children: dict = {}
        known = set(pdf["root_id"])
        for r in pdf.sort_values("root_id").itertuples():
            children.setdefault(r.parent_id if r.parent_id in known else None, []).append(r)
        out = ['<?xml version="1.0" encoding="UTF-8"?>', "<rsml><metadata><version>1</version><unit>mm</unit></metadata><scene><plant>"]
        todo: list = list(reversed(children.get(None, [])))
        while todo:
            r = todo.pop()
            if isinstance(r, str):
                out.append(r)
                continue
            held = [(n, getattr(r, n)) for n in properties]
            told = "".join(f"<{n} value={quoteattr(_number(v) if isinstance(v, float) else str(v))}/>" for n, v in held if v is not None and v == v)
            told = f"<properties>{told}</properties>" if told else ""
            widths = [p["r"] for p in (r.line if r.line is not None else []) if p["r"] is not None]
            drawn = f'<functions><function name="diameter" domain="polyline">{"".join(f"<sample>{_number(2 * w)}</sample>" for w in widths)}</function></functions>' if widths else ""
            points = "".join(f'<point x="{_number(p["x"])}" y="{_number(p["y"])}" z="{_number(p["z"])}"/>' for p in (r.line if r.line is not None else []))
            out.append(f"<root id={quoteattr(str(r.root_id))}>{told}<geometry><polyline>{points}</polyline></geometry>{drawn}")
            todo += ["</root>", *reversed(children.get(r.root_id, []))]
        out.append("</plant></scene></rsml>")
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "content": ["".join(out).encode()]})

    return rows.groupBy("sample_id").applyInPandas(build, "sample_id string, content binary")


def read_rsml(files: DataFrame) -> DataFrame:
    """The roots of RSML documents (sample_id, content): sample_id, root_id, parent_id, properties, nodes (array of x, y, z), diameters.

    Documents that are not XML give no rows.
    """
    from xml.etree import ElementTree

    schema = "sample_id string, root_id string, parent_id string, properties map<string,string>, nodes array<struct<x:double,y:double,z:double>>, diameters array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sample, content in zip(batch["sample_id"], batch["content"]):
                try:
                    top = ElementTree.fromstring(bytes(content))
                except ElementTree.ParseError:
                    continue
                todo = [(r, None) for p in top.iter("plant") for r in p.findall("root")]
                while todo:
                    r, parent = todo.pop()
                    own = r.get("id")
                    line = [{a: float(p.get(a)) for a in "xyz"} for p in r.findall("geometry/polyline/point")]
                    rows.append((sample, own, parent, {p.tag: p.get("value") for q in r.findall("properties") for p in q}, line, [float(x.text) for x in r.findall("functions/function[@name='diameter']/sample")]))
                    todo += [(c, own) for c in r.findall("root")]
                if len(rows) >= CHUNK:
                    yield pd.DataFrame(rows, columns=["sample_id", "root_id", "parent_id", "properties", "nodes", "diameters"])
                    rows = []
            yield pd.DataFrame(rows, columns=["sample_id", "root_id", "parent_id", "properties", "nodes", "diameters"])

    return files.select("sample_id", "content").mapInPandas(run, schema)


def hierarchy_json(roots: DataFrame) -> DataFrame:
    """Editable hierarchy rows as JSON text per root, with NaN as null: sample_id, root_id, document."""
    return roots.select("sample_id", "root_id", F.to_json(F.struct(F.lit("arborline.root-hierarchy/v1").alias("schema"), "root_id", "parent_id", "root_order", finite("confidence").alias("confidence"), "qc_flags"), {"ignoreNullFields": "false"}).alias("document"))


def write_files(files: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes ``sample_id, content`` rows to a shared folder, each under its name; gives sample_id, path, sha256. Refuses to write over a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for sample, content in zip(batch["sample_id"], batch["content"]):
                path = os.path.join(folder, f"{os.path.basename(str(sample))}.{suffix}")
                held = f"{path}.{os.getpid()}.part"
                with open(held, "wb") as f:
                    f.write(content)
                digest = hashlib.sha256(content).hexdigest()
                if os.path.exists(path):
                    with open(path, "rb") as f:
                        same = hashlib.sha256(f.read()).hexdigest() == digest
                    os.remove(held)
                    if not same:  # a task that is run again writes the same
                        raise FileExistsError(path)
                else:
                    os.replace(held, path)
                out.append((sample, path, digest))
            yield pd.DataFrame(out, columns=["sample_id", "path", "sha256"])

    return files.select("sample_id", "content").mapInPandas(run, "sample_id string, path string, sha256 string")


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per subject and a manifest of the columns; refuses a folder that has any of them."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        rows = [(n, c, t) for n, df in tables.items() for c, t in df.dtypes]
        spark.createDataFrame(rows, "table string, column string, type string").coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest.json")


def provenance(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """``path, sha256, config_sha256`` of each input file."""
    c = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    return raw_files(spark, path).select("path", F.sha2("content", 256).alias("sha256"), F.lit(c).alias("config_sha256"))
