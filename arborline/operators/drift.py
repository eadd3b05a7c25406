"""Fields of JSON files that drift over time: a tagged-union schema, one stable table, and a report of each change.

The files of a station are fused, one after the other, into a tagged union: a tree of fields in which each keeps all the
types it was seen with, the one seen last at the end. Fusing tells what changes: an alternative other than the last appears
at a field (retyped), a field comes or goes, or comes under another name. Unions of blocks of files are fused with each
other in the same way, which lets the blocks be read in parallel. Columns of the stable table are the fields of the
fused schema, fields joined by a renaming as one; a conflict of types becomes typed branches of one column (a struct with
the ``kind`` and a branch per type) beside a canonical conversion.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborline.common import stored
from arborline.operators.scan import range_blocks, scan_blocks

#: Names count as alike from this share of equal characters on (or if the words of one are among those of the other).
LIKE = 0.6

KINDS = ("string", "number", "boolean", "array", "object")


def kind_of(value: Any) -> str | None:
    """The type of a JSON value; null has none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _clean(text: str) -> str:
    """Text that can be stored as UTF-8 (half surrogates, which JSON can escape, become question marks)."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:"]|-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?|true|false|null|NaN|-?Infinity)')
_CONSTANTS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse_deep(text: str) -> Any:
    """A JSON text of any depth (the reader of the standard library gives up at some thousand levels)."""
    open_: list[tuple[Any, str | None]] = []
    root: list = []
    holder, name, at, want = root, None, 0, "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            if want == "end" and not open_ and not text[at:].strip(" \t\n\r"):
                return root[0]
            raise ValueError("not JSON")
        token, at = m[1], m.end()
        if want == "end":
            if not open_:
                raise ValueError("more than one value")
            if token == ",":
                want = "name" if isinstance(holder, dict) else "value"
            elif token == ("}" if isinstance(holder, dict) else "]"):
                holder, name = open_.pop()
            else:
                raise ValueError("not JSON")
        elif want in ("name", "first name"):
            if token == '"':
                name, at = scanstring(text, at)
                colon = _TOKEN.match(text, at)
                if colon is None or colon[1] != ":":
                    raise ValueError("not JSON")
                at, want = colon.end(), "value"
            elif token == "}" and want == "first name":
                holder, name = open_.pop()
                want = "end"
            else:
                raise ValueError("not JSON")
        else:
            if token == "]" and want == "first value":
                holder, name = open_.pop()
                want = "end"
                continue
            if token in ("{", "["):
                value: Any = {} if token == "{" else []
            elif token == '"':
                value, at = scanstring(text, at)
            elif token in _CONSTANTS:
                value = _CONSTANTS[token]
            elif token in ("}", "]", ",", ":"):
                raise ValueError("not JSON")
            else:
                value = float(token) if m[2] or m[3] else int(token)
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            want = "end"
            if token in ("{", "["):
                open_.append((holder, name))
                holder, want = value, "first name" if token == "{" else "first value"


def read_object(body: str | None) -> dict | None:
    """The JSON object that a text holds, with or without a byte order mark; None if it is not readable as one."""
    if body is None:
        return None
    body = body.lstrip("﻿")
    try:
        try:
            value = json.loads(body)
        except RecursionError:
            value = parse_deep(body)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def canonical(value: Any) -> str:
    """A value as JSON with sorted names, of any depth; whole numbers are written alike."""
    out: list[str] = []
    todo: list[Any] = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):
            out.append(v[0])
        elif isinstance(v, dict):
            todo.append(("}",))
            for i, k in enumerate(sorted(v, reverse=True)):
                todo += [v[k], ((", " if i < len(v) - 1 else "") + json.dumps(k) + ": ",)]
            todo.append(("{",))
        elif isinstance(v, list):
            todo.append(("]",))
            for i in range(len(v) - 1, -1, -1):
                todo += [v[i], (", " if i else "",)]
            todo.append(("[",))
        elif isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            out.append(str(int(v)))
        else:
            out.append(json.dumps(v))
    return "".join(out)


def json_text(value: Any) -> str:
    try:
        return json.dumps(value, sort_keys=True)
    except RecursionError:
        return canonical(value)


def _mark(value: Any) -> str:
    text = canonical(value)
    return text if len(text) <= 64 else hashlib.sha256(text.encode()).hexdigest()


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())


def name_likeness(a: str, b: str) -> float:
    """0 to 1; 1 if both names have the same words, 0.9 if those of one are among those of the other."""
    u, v = _words(a), _words(b)
    if u == v:
        return 1.0
    if u and v and (set(u) <= set(v) or set(v) <= set(u)):
        return 0.9
    return SequenceMatcher(None, "".join(u), "".join(v), autojunk=False).ratio()


class Union:
    """The tagged union of a run of files: a tree of fields, parents before children, with the alternatives of each.

    ``kinds``: the types a field was seen with, in the order in which they were seen last. ``now``, ``held``: its type
    and value in the latest file, if it is there (``seen`` is then the number of files).
    """

    __slots__ = ("files", "held", "kids", "kinds", "name", "now", "seen", "up")

    def __init__(self) -> None:
        self.files = 0
        self.up, self.name, self.kids = [-1], [""], [{}]
        self.kinds: list[list[str]] = [[]]
        self.now: list[str | None] = ["object"]
        self.seen, self.held = [0], [None]

    def _field(self, parent: int, name: str) -> int:
        i = self.kids[parent].get(name)
        if i is None:
            i = self.kids[parent][name] = len(self.name)
            self.up.append(parent)
            self.name.append(name)
            self.kids.append({})
            self.kinds.append([])
            self.now.append(None)
            self.seen.append(0)
            self.held.append(None)
        return i

    def path(self, i: int) -> str:
        parts = []
        while i > 0:
            parts.append(self.name[i])
            i = self.up[i]
        return ".".join(reversed(parts))

    def _renamed(self, gone: list[int], come: list[str], obj: dict) -> list[tuple[int, str]]:
        """Pairs of a field that goes and one of the same type that comes, with a like name or the same value; best pairs first."""
        pairs = []
        for g in gone:
            last = self.kinds[g][-1] if self.kinds[g] else None
            for c in come:
                if last is None or kind_of(obj[c]) != last:
                    continue
                old = self.held[g]
                likeness = name_likeness(self.name[g], c)
                same = self.now[g] is not None and (old[0] if isinstance(old, tuple) else _mark(old)) == _mark(obj[c])
                if likeness >= LIKE or same:
                    pairs.append((-(likeness + same), self.name[g], c, g))
        out, used = [], set()
        for _, _, c, g in sorted(pairs):
            if g not in used and c not in used:
                used |= {g, c}
                out.append((g, c))
        return out

    def fuse(self, doc: dict) -> list[tuple[str, str, str]]:
        """Takes the next file in; returns what changes against the latest: (change, path, new path)."""
        latest, self.files = self.files, self.files + 1
        out: list[tuple[str, str, str]] = []
        todo = [(0, doc, latest > 0)]
        while todo:
            node, obj, compared = todo.pop()
            kids = self.kids[node]
            if compared:
                gone = [i for k, i in kids.items() if self.seen[i] == latest and k not in obj]
                come = [k for k in obj if k not in kids or self.seen[kids[k]] != latest]
                pairs = self._renamed(gone, come, obj) if gone and come else []
                at = self.path(node) + "." if node and (gone or come) else ""
                out += [("renamed", at + self.name[g], at + c) for g, c in pairs]
                left, new = {g for g, _ in pairs}, {c for _, c in pairs}
                out += [("removed", at + self.name[g], "") for g in gone if g not in left]
                out += [("added", at + c, "") for c in come if c not in new]
            for k, v in obj.items():
                kind, i = kind_of(v), self._field(node, k)
                there = compared and self.seen[i] == latest
                kinds = self.kinds[i]
                if there and kind and kinds and kinds[-1] != kind:
                    out.append(("retyped", self.path(i), ""))
                inside = there and kind == self.now[i] == "object"
                if kind and (not kinds or kinds[-1] != kind):
                    if kind in kinds:
                        kinds.remove(kind)
                    kinds.append(kind)
                self.now[i], self.seen[i], self.held[i] = kind, self.files, v
                if kind == "object":
                    todo.append((i, v, inside))
        return out

    def then(self, later: Union) -> Union:
        """Fuses the union of later files in."""
        place = [0] * len(later.name)
        self.files, self.seen = 1, [0] * len(self.name)
        for j in range(1, len(later.name)):
            i = place[j] = self._field(place[later.up[j]], later.name[j])
            self.kinds[i] = [k for k in self.kinds[i] if k not in later.kinds[j]] + later.kinds[j]
            self.now[i], self.held[i] = later.now[j], later.held[j]
            self.seen[i] = int(later.seen[j] == later.files)
        return self

    def pack(self) -> bytes:
        """Fields as flat rows; of a value only what an equal one can be known by."""
        rows = []
        for i in range(1, len(self.name)):
            here = self.seen[i] == self.files
            held = self.held[i]
            rows.append([self.up[i], self.name[i], self.kinds[i], self.now[i], here, (held[0] if isinstance(held, tuple) else _mark(held)) if here else ""])
        return json.dumps(rows).encode()

    @staticmethod
    def unpack(data: bytes | None) -> Union:
        out = Union()
        if data is not None:
            out.files = 1
            for up, name, kinds, now, here, mark in json.loads(data):
                i = out._field(up, name)
                out.kinds[i], out.now[i], out.seen[i], out.held[i] = kinds, now, int(here), (mark,)
        return out


def readable_files(sessions: DataFrame) -> DataFrame:
    """Each readable file once (its earliest delivery): file_id, station_id, session_id, written_at, body.

    Rows without a file, station or time, and bodies that are not JSON objects, are left out.
    """

    @F.pandas_udf(T.BooleanType())
    def readable(body: pd.Series) -> pd.Series:
        return body.map(lambda x: read_object(x) is not None).astype(bool)

    rows = sessions.select("file_id", "station_id", "session_id", "written_at", "received_at", "body")
    rows = rows.dropna(subset=["file_id", "station_id", "written_at"]).filter(readable("body"))
    first = rows.groupBy("file_id").agg(F.min(F.struct("received_at", "written_at", "station_id", "session_id", "body")).alias("d"))
    return first.select("file_id", "d.station_id", "d.session_id", "d.written_at", "d.body")


def _changes(files: DataFrame, blocks: int | None = None) -> DataFrame:
    ordered = range_blocks(files.select("station_id", "written_at", "file_id", "body"), "station_id", ["written_at", "file_id"], blocks)

    def summarise(rows: Iterator[dict]) -> bytes:
        union = Union()
        for row in rows:
            union.fuse(read_object(row["body"]))
        return union.pack()

    def combine(before: bytes | None, summary: bytes) -> bytes:
        return summary if before is None else Union.unpack(before).then(Union.unpack(summary)).pack()

    def emit(_: Any, rows: Iterator[dict], state: bytes | None) -> Iterator[dict]:
        union = Union.unpack(state)
        for row in rows:
            for change, path, new_path in union.fuse(read_object(row["body"])):
                yield {"file_id": row["file_id"], "change": change, "field_path": _clean(path), "new_path": _clean(new_path)}

    return scan_blocks(ordered, "station_id", summarise, combine, emit, "file_id long, change string, field_path string, new_path string")


def schema_changes(sessions: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per change of a field that fusing a readable file into its station's tagged union brings.

    ``file_id, change, field_path, new_path``; ``change`` is added, removed, retyped or renamed. A station's history is
    fused in blocks (see scan), so that no station passes through one task. Files written at the same time come in the
    order of their ids. An empty table gives an empty report; unreadable files count as not there. Objects may lie in
    each other to any depth.
    """
    return _changes(readable_files(sessions), blocks)


def fields_of(doc: dict) -> Iterator[tuple[str, str | None, Any]]:
    """All fields of a file, objects and what is in them: path, type, value."""
    todo = [("", doc)]
    while todo:
        at, obj = todo.pop()
        for k, v in obj.items():
            yield at + k, kind_of(v), v
            if isinstance(v, dict):
                todo.append((f"{at}{k}.", v))


def _fused_schema(files: DataFrame) -> DataFrame:
    """path, kind, files, first and last (written_at, file_id): each task fuses the schemas of its files, the sums are fused by path and kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n, *a, *b) for k, (n, a, b) in held.items()], columns=["path", "kind", "files", "first_at", "first_file_id", "last_at", "last_file_id"])
            held.clear()
            return out

        for batch in batches:
            for file_id, at, body in zip(batch["file_id"], batch["written_at"], batch["body"]):
                when = (at, file_id)
                for key in {(_clean(p), kind) for p, kind, _ in fields_of(read_object(body) or {})}:
                    own = held.setdefault(key, [0, when, when])
                    own[0] += 1
                    own[1], own[2] = min(own[1], when), max(own[2], when)
            if len(held) > 200_000:
                yield rows()
        yield rows()

    rows = files.select("file_id", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "body")
    part = rows.mapInPandas(run, "path string, kind string, files long, first_at timestamp_ntz, first_file_id long, last_at timestamp_ntz, last_file_id long")
    first, last = F.min(F.struct("first_at", "first_file_id")), F.max(F.struct("last_at", "last_file_id"))
    return part.groupBy("path", "kind").agg(F.sum("files").alias("files"), first["first_file_id"].alias("first_file_id"), last["last_file_id"].alias("last_file_id"))


def union_schema(sessions: DataFrame) -> DataFrame:
    """The tagged-union schema of all files: each path with each type seen in it, and the file in which it appeared first.

    ``path, kind, files, first_file_id, last_file_id, alternatives`` (the number of types of the path). A path that was
    only ever null has the kind null. Grows with the distinct fields, not with the files.
    """
    rows = _fused_schema(readable_files(sessions))
    per = rows.groupBy("path").agg(F.count("kind").cast("int").alias("alternatives"))
    return rows.join(per, "path").select("path", "kind", "files", "first_file_id", "last_file_id", "alternatives")


def leading_paths(kinds: dict[str, set[str | None]]) -> list[str]:
    """The paths that become columns: those that are ever more than an object of further fields, and lie in no such path."""
    inner = {p[: i] for p in kinds for i, c in enumerate(p) if c == "."}
    out: set[str] = set()
    for path in sorted(kinds, key=lambda p: p.count(".")):
        above = any(path[:i] in out for i, c in enumerate(path) if c == ".")
        if not above and (kinds[path] - {None, "object"} or path not in inner):
            out.add(path)
    return sorted(out)


def _name(path: str, taken: set[str]) -> str:
    base = re.sub(r"\W+", "_", path).strip("_").lower() or "field"
    name, n = base, 2
    while name in taken or f"{name}_number" in taken or f"{name}_text" in taken:
        name, n = f"{base}_{n}", n + 1
    taken |= {name, f"{name}_number", f"{name}_text"}
    return name


def inferred_fields(files: DataFrame) -> dict[str, list[str]]:
    """The columns of the stable table, from the fused schema and the renamings: column to its paths, the most frequent first.

    Paths that a renaming joins are one column, unless some file has both. Reads the files three times; the driver holds
    the distinct paths and renamings, which are the schema itself.
    """
    files = stored(files)
    schema = _fused_schema(files).collect()
    kinds: dict[str, set] = {}
    count: Counter = Counter()
    for r in schema:
        kinds.setdefault(r["path"], set()).add(r["kind"])
        count[r["path"]] += r["files"]
    paths = leading_paths(kinds)
    moved = _changes(files).filter("change = 'renamed'").groupBy("field_path", "new_path").count().collect()
    known = set(paths)
    links: Counter = Counter()
    for r in moved:
        a, b = r["field_path"], r["new_path"]
        for p in [a, *(x for x in paths if x.startswith(a + "."))]:  # what lies in a renamed object moves with it
            q = b + p[len(a):]
            if p in known and q in known:
                links[tuple(sorted((p, q)))] += r["count"]
    linked = sorted({p for pair in links for p in pair})
    number = {p: i for i, p in enumerate(linked)}

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for body in batch["body"]:
                own = sorted(number[p] for p in {_clean(p) for p, _, _ in fields_of(read_object(body) or {})} if p in number)
                seen.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["a", "b", "n"])

    both = {(r["a"], r["b"]) for r in files.select("body").mapInPandas(together, "a long, b long, n long").select("a", "b").distinct().collect()} if linked else set()
    group = {p: [p] for p in paths}
    for (p, q), _ in sorted(links.items(), key=lambda x: (-x[1], x[0])):
        u, v = group[p], group[q]
        if u is not v and not any(tuple(sorted((number[a], number[b]))) in both for a in u for b in v if a in number and b in number):
            u += v
            for x in v:
                group[x] = u
    out: dict[str, list[str]] = {}
    taken = {"file_id", "station_id", "session_id", "written_at", "rest"}
    for own in sorted({id(u): sorted(u, key=lambda p: (-count[p], p)) for u in group.values()}.values()):
        out[_name(own[0], taken)] = own
    return out


#: The words that files use for true and false.
TRUE_WORDS, FALSE_WORDS = ("true", "on", "yes", "1"), ("false", "off", "no", "0")


def canonical_number(value: Any) -> float | None:
    """A number out of a number, its text, a list of one, or an object with a ``value``."""
    while True:
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, dict):
            value = value.get("value", value.get("version"))
        else:
            break
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _float(value)
    if isinstance(value, str) and (m := re.search(r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?", value)):
        return float(m[0].replace(",", "."))
    return None


def _float(value: float) -> float:
    try:
        return float(value)
    except OverflowError:  # a whole number beyond the doubles
        return float("inf") if value > 0 else float("-inf")


def canonical_boolean(value: Any) -> bool | None:
    """True or false out of a boolean, its words or its numbers."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower() if isinstance(value, (str, int)) else None
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def canonical_text(value: Any) -> str | None:
    """Text as it stands, other values as JSON; null stays null."""
    if value is None:
        return None
    return _clean(value) if isinstance(value, str) else json_text(value)


def stable_table(sessions: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per readable file with the same columns whatever the file's fields are called and typed.

    ``fields`` maps a column to the dotted paths (its names over time) that mean it, the first present one counts; without
    it the columns come from the fused schema and the renamings of these files (``inferred_fields``). Each column ``c``
    is a struct ``kind`` (null: absent or null), ``name`` (the path found) and a branch per type (``array`` and
    ``object`` as JSON text); ``c_number``, ``c_boolean`` and ``c_text`` are canonical conversions. Further fields are kept
    in ``rest``, a map from path to JSON text, so that nothing is lost.
    """
    files = readable_files(sessions)
    if fields is None:
        files = stored(files)
        fields = inferred_fields(files)
    branch = "struct<kind:string,name:string,string:string,number:double,boolean:boolean,array:string,object:string>"
    columns = list(fields)
    schema = "file_id long, station_id string, session_id string, written_at timestamp" + "".join(f", `{c}` {branch}, `{c}_number` double, `{c}_boolean` boolean, `{c}_text` string" for c in columns) + ", rest map<string,string>"
    column = {p: c for c in columns for p in fields[c]}
    above = {p[:i] for p in column for i, x in enumerate(p) if x == "."}

    def leaves(doc: dict) -> Iterator[tuple[str, Any]]:
        """Fields down to those that are columns, or that hold none."""
        todo = [("", doc)]
        while todo:
            at, obj = todo.pop()
            for k, v in obj.items():
                path = _clean(at + k)
                if isinstance(v, dict) and path in above and path not in column:
                    todo.append((f"{at}{k}.", v))
                else:
                    yield path, v

    def cell(path: str | None, value: Any) -> dict:
        kind = kind_of(value)
        out = dict.fromkeys(("kind", "name", *KINDS)) | {"kind": kind, "name": path}
        if kind:
            out[kind] = json_text(value) if kind in ("array", "object") else _float(value) if kind == "number" else _clean(value) if kind == "string" else value
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found = dict(leaves(read_object(row.pop("body")) or {}))
                for c in columns:
                    path = next((p for p in fields[c] if p in found), None)
                    value = found.pop(path) if path else None
                    row |= {c: cell(path, value), f"{c}_number": canonical_number(value), f"{c}_boolean": canonical_boolean(value), f"{c}_text": canonical_text(value)}
                row["rest"] = {p: json_text(v) for p, v in found.items()}
                out.append(row)
            if out:
                yield pd.DataFrame(out)

    return files.select("file_id", "station_id", "session_id", "written_at", "body").mapInPandas(run, schema)
