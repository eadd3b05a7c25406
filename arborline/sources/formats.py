"""Bytes of geometry files to arrays and back: STL, PLY, OBJ, OFF, XYZ and named CSV. Plain NumPy, one file at a time."""

from __future__ import annotations

import csv
import re
import struct

import numpy as np

MESH_SUFFIXES = ("stl", "ply", "obj", "off")
POINT_SUFFIXES = ("ply", "xyz", "xyzn", "xyzrgb", "pts", "txt", "csv")

# The scalar types of PLY and their sizes.
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


class Geometry:
    """Vertices (n, 3), faces (m, 3) and further columns of the vertices."""

    def __init__(self, points: np.ndarray, faces: np.ndarray | None = None, extra: dict[str, np.ndarray] | None = None) -> None:
        self.points = np.asarray(points, float).reshape(-1, 3)
        self.faces = np.zeros((0, 3), np.int64) if faces is None else np.asarray(faces, np.int64).reshape(-1, 3)
        self.extra = extra or {}


def is_binary_stl(data: bytes) -> bool:
    """Whether the size is that of 80 header bytes, a count, and 50 bytes per facet."""
    return len(data) >= 84 and len(data) == 84 + 50 * struct.unpack("<I", data[80:84])[0]


def read_stl(data: bytes) -> Geometry:
    """Facets as they stand: three vertices of their own each."""
    if is_binary_stl(data):
        kind = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
        points = np.frombuffer(data[84:], kind)["corners"].reshape(-1, 3).astype(float)
    else:
        found = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
        if len(found) % 3 or not data.lstrip().startswith(b"solid"):
            raise ValueError("not an STL file")
        points = np.array(found, float).reshape(-1, 3)
    return Geometry(points, np.arange(len(points)).reshape(-1, 3))


def _ply_header(data: bytes) -> tuple[str, list[tuple[str, int, list]], int]:
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    start = data.index(b"\n", end) + 1
    form, elements = "", []
    for line in data[:end].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[2:4] if w[1] == "list" else w[1]))
    return form, elements, start


def _triangles(corners: np.ndarray) -> np.ndarray:
    """Polygons of one size (n, size) fanned to triangles."""
    fans = max(corners.shape[1] - 2, 0)
    return np.stack([np.repeat(corners[:, :1], fans, 1), corners[:, 1:-1], corners[:, 2:]], 2).reshape(-1, 3)


def _ply_body(form: str, elements: list[tuple[str, int, list]], data: bytes, at: int) -> tuple[Geometry, int]:
    """The elements that begin at a place, and (binary forms) the place at which they end."""
    order = ">" if "big" in form else "<"
    words = data[at:].split() if form == "ascii" else []
    k, columns, faces = 0, {}, []
    for name, n, properties in elements:
        scalars = [p for p in properties if isinstance(p[1], str)]
        if len(scalars) == len(properties):
            kind = np.dtype([(p, order + _PLY_TYPES[t]) for p, t in properties])
            if form == "ascii":
                rows = np.array(words[k : k + n * len(properties)], float).reshape(n, len(properties))
                k += n * len(properties)
                held = {p: rows[:, i] for i, (p, _) in enumerate(properties)}
            else:
                rows = np.frombuffer(data, kind, n, at)
                at += n * kind.itemsize
                held = {p: rows[p].astype(float) for p, _ in properties}
            if name == "vertex":
                columns = held
            continue
        if form != "ascii" and len(properties) == 1 and n:  # lists of one length are read at once
            p, t = properties[0]
            count, item = np.dtype(order + _PLY_TYPES[t[0]]), np.dtype(order + _PLY_TYPES[t[1]])
            size = int(np.frombuffer(data, count, 1, at)[0])
            if 0 <= size and at + n * (count.itemsize + size * item.itemsize) <= len(data):
                kind = np.dtype([("n", count), ("c", item, (size,))])
                rows = np.frombuffer(data, kind, n, at)
                if (rows["n"] == size).all():
                    at += n * kind.itemsize
                    if name == "face" and p in ("vertex_indices", "vertex_index"):
                        faces.append(_triangles(rows["c"].astype(np.int64)))
                    continue
        found = []
        for _ in range(n):
            for p, t in properties:
                if isinstance(t, str):
                    if form == "ascii":
                        k += 1
                    else:
                        at += np.dtype(_PLY_TYPES[t]).itemsize
                    continue
                if form == "ascii":
                    size = int(words[k])
                    corners = [int(w) for w in words[k + 1 : k + 1 + size]]
                    k += 1 + size
                else:
                    count, item = np.dtype(order + _PLY_TYPES[t[0]]), np.dtype(order + _PLY_TYPES[t[1]])
                    size = int(np.frombuffer(data, count, 1, at)[0])
                    corners = np.frombuffer(data, item, size, at + count.itemsize).tolist()
                    at += count.itemsize + size * item.itemsize
                if name == "face" and p in ("vertex_indices", "vertex_index"):
                    found += [(corners[0], corners[i], corners[i + 1]) for i in range(1, size - 1)]
        faces.append(np.array(found, np.int64).reshape(-1, 3))
    points = np.stack([columns[a] for a in "xyz"], 1) if columns else np.zeros((0, 3))
    return Geometry(points, np.concatenate(faces) if faces else None, {c: v for c, v in columns.items() if c not in "xyz"}), at


def read_ply(data: bytes) -> Geometry:
    """ASCII and binary PLY; polygons are fanned to triangles, further scalar columns of the vertices are kept."""
    form, elements, at = _ply_header(data)
    return _ply_body(form, elements, data, at)[0]


def ply_counts(head: bytes) -> list[int]:
    """The rows of each element that a header names."""
    return [n for _, n, _ in _ply_header(head)[1]]


def read_ply_piece(head: bytes, element: int, rows: int, data: bytes) -> Geometry:
    """Whole rows of one element of a binary PLY file (1: the first that the header names), without the rest of the file."""
    form, elements, _ = _ply_header(head)
    name, _, properties = elements[element - 1]
    g, end = _ply_body(form, [(name, rows, properties)], data, 0)
    if end != len(data):
        raise ValueError("the bytes are not the rows")
    return g


def read_obj(data: bytes) -> Geometry:
    points, faces = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            points.append([float(x) for x in w[1:4]])
        elif w[:1] == ["f"]:
            c = [int(x.split("/")[0]) for x in w[1:]]
            c = [x - 1 if x > 0 else len(points) + x for x in c]
            faces += [(c[0], c[i], c[i + 1]) for i in range(1, len(c) - 1)]
    return Geometry(np.array(points), np.array(faces))


def read_off(data: bytes) -> Geometry:
    w = [x for line in data.decode("utf-8", "replace").splitlines() for x in line.split("#")[0].split()]
    if not w or w[0] != "OFF":
        raise ValueError("not an OFF file")
    n, m = int(w[1]), int(w[2])
    points, k, faces = np.array(w[4 : 4 + 3 * n], float), 4 + 3 * n, []
    for _ in range(m):
        size = int(w[k])
        c = [int(x) for x in w[k + 1 : k + 1 + size]]
        faces += [(c[0], c[i], c[i + 1]) for i in range(1, size - 1)]
        k += 1 + size
    return Geometry(points, np.array(faces))


def read_points(data: bytes) -> Geometry:
    """The columns x, y, z if a header names them in any case, else the first three numbers of each row; other rows are skipped."""
    lines = data.decode("utf-8", "replace").splitlines()
    head = [x.strip().lower() for x in next(csv.reader(lines[:1]), [])]
    named = {"x", "y", "z"} <= set(head)
    at = [head.index(a) for a in "xyz"] if named else [0, 1, 2]
    rows = csv.reader(lines[1:]) if named else (re.split(r"[,;\s]+", line.strip()) for line in lines)
    points = []
    for row in rows:
        try:
            points.append([float(row[i]) for i in at])
        except (ValueError, IndexError):
            continue
    return Geometry(np.array(points))


def read(name: str, data: bytes) -> Geometry:
    """By the suffix of the name."""
    suffix = name.rpartition(".")[2].lower()
    reader = {"stl": read_stl, "ply": read_ply, "obj": read_obj, "off": read_off}.get(suffix)
    if reader is None and suffix not in POINT_SUFFIXES:
        raise ValueError(f"unknown kind of geometry file: {name}")
    return (reader or read_points)(data)


def header_text(data: bytes) -> str | None:
    """The header of a binary STL file as text, in which exporters declare units; None for other files."""
    return data[:80].split(b"\0")[0].decode("latin-1").strip() if is_binary_stl(data) else None


def ply_head(vertices: int | str, faces: int | str, names: list[str]) -> bytes:
    """The header of what ``ply_vertices`` and ``ply_faces`` write; ``names``: the further columns of the vertices, sorted."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {vertices}", *(f"property double {a}" for a in "xyz"), *(f"property int {c}" for c in names), f"element face {faces}", "property list uchar int vertex_indices", "end_header"]
    return ("\n".join(head) + "\n").encode()


def ply_vertices(points: np.ndarray, extra: dict[str, np.ndarray]) -> bytes:
    names = sorted(extra)
    rows = np.zeros(len(points), np.dtype([*((a, "<f8") for a in "xyz"), *((c, "<i4") for c in names)]))
    for i, a in enumerate("xyz"):
        rows[a] = points[:, i]
    for c in names:
        rows[c] = extra[c]
    return rows.tobytes()


def ply_faces(faces: np.ndarray) -> bytes:
    f = np.zeros(len(faces), np.dtype([("n", "u1"), ("c", "<i4", 3)]))
    f["n"], f["c"] = 3, faces
    return f.tobytes()


def write_ply(g: Geometry) -> bytes:
    """Binary little-endian PLY with double coordinates and int columns of ``extra``."""
    return ply_head(len(g.points), len(g.faces), sorted(g.extra)) + ply_vertices(g.points, g.extra) + ply_faces(g.faces)


def write_stl(g: Geometry, header: str = "") -> bytes:
    kind = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
    rows = np.zeros(len(g.faces), kind)
    rows["corners"] = g.points[g.faces]
    a, b, c = (rows["corners"][:, i].astype(float) for i in range(3))
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1, keepdims=True)
    rows["normal"] = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    return header.encode("latin-1", "replace")[:80].ljust(80, b"\0") + struct.pack("<I", len(rows)) + rows.tobytes()
