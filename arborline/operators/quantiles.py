"""Percentiles of very many numbers per group from dyadic Count-sketches.

A positive number is encoded by the upper BITS bits of its double, which keep the order, so that every double has a code
and none is cut off. Each binary resolution of the codes, from the exponent alone to all bits, is one level. A level is a
signed Count-sketch, except that the coarse levels, as far as they have at most CELLS occupied cells, are held by the
counts of their cells (of the finest such level; the coarser ones are its sums), which is smaller and has no error. All of
it is linear: the sketches of tasks, parts or days are added, and rows can be taken out again by subtraction. A rank is
inverted by descending from the counted level, with the estimated count of the left half at each finer one.

Rows are sketched where they lie and only packed sketches are shuffled, so a hot group comes to a task as one
sketch of each task before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborline.common import finite, partitions, stored

EXPONENT, MANTISSA = 11, 12  # bits of a code
BITS = EXPONENT + MANTISSA
DEPTH, WIDTH = 5, 2048  # rows and counters per row of a sketch
CELLS = 2048  # occupied cells up to which a level is counted; the coarsest level has no more in all

#: Relative half-width of a code (of normal doubles), the error of the value at a rank.
VALUE_ERROR = 2.0 ** -(MANTISSA + 1)

#: Standard deviations of a counter's noise that the stated rank error allows for each level, and the heaviest counters of a row that do not count in it.
SIGMAS, HEAVY = 4.0, WIDTH // 32

_SHIFT = np.uint64(63 - BITS)
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def encode(values: np.ndarray) -> np.ndarray:
    """The codes of positive finite numbers."""
    return (np.ascontiguousarray(values, np.float64).view(np.uint64) >> _SHIFT).astype(np.int64)


def decode(codes: np.ndarray | int) -> np.ndarray:
    """The middle of the values of each code."""
    bits = (np.asarray(codes, np.uint64) << _SHIFT) | (np.uint64(1) << (_SHIFT - np.uint64(1)))
    return bits.view(np.float64)


def _places(cells: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter and the sign of each cell in each row of the sketch of a level."""
    x = (cells.astype(np.uint64)[None, :] + np.uint64(1 + (level << 40))) * _A[:, None]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x & np.uint64(WIDTH - 1)).astype(np.int64) + _ROWS, np.where(x >> np.uint64(63), 1, -1).astype(np.int64)


_ROWS = np.arange(DEPTH)[:, None] * WIDTH


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, with its counts added up; cells that come to 0 are left out."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    cells, counts = cells[start], np.add.reduceat(counts, start) if len(start) else counts
    return cells[counts != 0], counts[counts != 0]


def _sketched(cells: np.ndarray, counts: np.ndarray, level: int) -> np.ndarray:
    at, sign = _places(cells, level)
    return np.bincount(at.ravel(), (sign * counts).ravel(), DEPTH * WIDTH).astype(np.int64)


class Sketch:
    """The counts of one group: ``cells`` and ``counts`` of the level ``exact``, and ``fine``, a Count-sketch for each finer level."""

    __slots__ = ("cells", "counts", "exact", "fine")

    def __init__(self) -> None:
        self.exact, self.cells, self.counts = BITS, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fine: dict[int, np.ndarray] = {}

    def _coarsen(self, level: int | None = None) -> Sketch:
        """Goes down to ``level``, or until few enough cells are occupied; levels left behind become sketches."""
        while self.exact > level if level is not None else len(self.cells) > CELLS:
            self.fine[self.exact] = _sketched(self.cells, self.counts, self.exact)
            self.exact -= 1
            self.cells, self.counts = _summed(self.cells >> 1, self.counts)
        return self

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> Sketch:
        """Counts codes in; negative counts take them out."""
        own = Sketch()
        own.cells, own.counts = _summed(np.asarray(codes, np.int64), np.ones(len(codes), np.int64) if counts is None else np.asarray(counts, np.int64))
        return self.merge(own)

    def merge(self, other: Sketch, times: int = 1) -> Sketch:
        """Adds another sketch (or with ``times`` -1, takes it out)."""
        level = min(self.exact, other.exact)
        cells, counts = other.cells, other.counts
        self._coarsen(level)
        for k in range(other.exact, level, -1):
            self.fine[k] = self.fine[k] + times * _sketched(cells, counts, k)
            cells, counts = _summed(cells >> 1, counts)
        for k, own in other.fine.items():
            self.fine[k] = self.fine[k] + times * own
        self.cells, self.counts = _summed(np.r_[self.cells, cells], np.r_[self.counts, times * counts])
        return self._coarsen()

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    @property
    def size(self) -> int:
        """Bytes held."""
        return 16 * len(self.cells) + 8 * DEPTH * WIDTH * len(self.fine) + 500

    def _count(self, level: int, cell: int) -> int:
        at, sign = _places(np.array([cell]), level)
        return int(np.median(self.fine[level][at[:, 0]] * sign[:, 0]))

    def code_at(self, share: float) -> int:
        """The code that holds the rank ``ceil(share * total)``, by descending the levels."""
        target = max(1, int(np.ceil(share * self.total - 1e-9)))
        sums = np.cumsum(self.counts)
        i = min(int(np.searchsorted(sums, target)), len(sums) - 1)
        cell, rest, held = int(self.cells[i]), target - int(sums[i] - self.counts[i]), int(self.counts[i])
        for level in range(self.exact + 1, BITS + 1):
            left, right = self._count(level, 2 * cell), self._count(level, 2 * cell + 1)
            left = min(held, max(0, round((left + held - right) / 2)))  # both halves tell of the left one
            if rest <= left:
                cell, held = 2 * cell, left
            else:
                cell, rest, held = 2 * cell + 1, rest - left, held - left
        return cell

    def rank_error(self) -> float:
        """A bound on the error in rank, as a share of the total; 0 where all levels are counted.

        In a row of a sketch a cell's estimate is off by sqrt(F2 / WIDTH) on average, with F2 the second moment of the
        cells that are not among the HEAVY heaviest (which share its counter with a chance of 1 in 32). It is so off by more
        than SIGMAS times that with a chance of at most 1/32 + 1/16, and the median of DEPTH rows of under 0.8 percent
        (much less in fact, the bound is Chebyshev's). The levels have hashes of their own, so their variances add up.
        """
        n = self.total
        if not self.fine or not n:
            return 0.0
        rows = np.sort(np.stack([x.reshape(DEPTH, WIDTH) for x in self.fine.values()]).astype(float) ** 2, axis=2)
        f2 = np.median(rows[:, :, : WIDTH - HEAVY].sum(axis=2), axis=1)
        return min(1.0, float(SIGMAS * np.sqrt((f2 / WIDTH).sum()) / n))

    def pack(self) -> bytes:
        head = np.array([self.exact, len(self.cells)], "<i8")
        return zlib.compress(b"".join([head.tobytes(), self.cells.astype("<i8").tobytes(), self.counts.astype("<i8").tobytes(), *(self.fine[k].astype("<i8").tobytes() for k in range(self.exact + 1, BITS + 1))]), 1)

    @staticmethod
    def unpack(data: bytes) -> Sketch:
        flat = np.frombuffer(zlib.decompress(data), "<i8").astype(np.int64)
        out, n = Sketch(), int(flat[1])
        out.exact, out.cells, out.counts = int(flat[0]), flat[2 : 2 + n].copy(), flat[2 + n : 2 + 2 * n].copy()
        rest = flat[2 + 2 * n :].reshape(-1, DEPTH * WIDTH)
        out.fine = {out.exact + 1 + i: x.copy() for i, x in enumerate(rest)}
        return out


def _kinds(df: DataFrame, groups: list[str]) -> str:
    return ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)


def _key(values: tuple) -> tuple:
    return tuple(None if v is None or v != v else v for v in values)


#: Rows that a task takes together before it sketches them, and bytes of sketches that it holds before it hands them on.
HOLD_ROWS, HOLD_BYTES = 300_000, 64 << 20


def _sketch_rows(batches: Iterator[pd.DataFrame], groups: list[str]) -> Iterator[pd.DataFrame]:
    """The sketches of the groups of a task's rows (groups, value, n); a group may come more than once."""
    names: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sketches: dict[int, Sketch] = {}
    rows = size = 0

    def fold() -> None:
        nonlocal held, rows, size
        g, c, n = (np.concatenate(x) for x in zip(*held))
        held, rows = [], 0
        order = np.lexsort((c, g))
        g, c, n = g[order], c[order], n[order]
        start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        g, c, n = g[start], c[start], np.add.reduceat(n, start)
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for a, b in zip(edge, np.r_[edge[1:], len(g)]):
            s = sketches.setdefault(int(g[a]), Sketch())
            size -= s.size
            own = Sketch()
            own.cells, own.counts = c[a:b], n[a:b]
            size += s.merge(own).size

    def out() -> Iterator[pd.DataFrame]:
        nonlocal size
        back = list(names)
        keys = list(sketches)
        for k in range(0, len(keys), 500):
            yield pd.DataFrame([(*back[i], sketches[i].total, sketches[i].pack()) for i in keys[k : k + 500]], columns=[*groups, "total", "sketch"])
        sketches.clear()
        names.clear()
        size = 0

    for batch in batches:
        if not len(batch):
            continue
        parts = [pd.factorize(batch[c]) for c in groups]
        code = np.zeros(len(batch), np.int64)
        for k, u in parts:
            code = code * (len(u) + 1) + k + 1
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        own = [tuple(None if k[f] < 0 else u[k[f]] for k, u in parts) for f in first]
        number = np.array([names.setdefault(key, len(names)) for key in own], np.int64)
        held.append((number[back], encode(batch["value"].to_numpy()), batch["n"].to_numpy(np.int64)))
        rows += len(batch)
        if rows >= HOLD_ROWS:
            fold()
            if size > HOLD_BYTES:
                yield from out()
    if held:
        fold()
    yield from out()


def _merged(batches: Iterator[pd.DataFrame], groups: list[str]) -> Iterator[tuple[tuple, Sketch]]:
    """The sum of the sketches of each group of a sorted partition, one group at a time."""
    current, s = None, None
    for batch in batches:
        for key, data in zip(batch[groups].itertuples(index=False, name=None), batch["sketch"]):
            key = _key(key)
            if key == current:
                s.merge(Sketch.unpack(data))
                continue
            if s is not None:
                yield current, s
            current, s = key, Sketch.unpack(data)
    if s is not None:
        yield current, s


def _together(parts: DataFrame, groups: list[str]) -> DataFrame:
    return parts.select(*groups, "sketch").repartition(partitions(parts.sparkSession), *groups).sortWithinPartitions(*groups)


def _partial(values: DataFrame, groups: list[str], value: str, weight: Column | None = None) -> DataFrame:
    v = finite(value)
    rows = values.filter(v > 0).select(*groups, v.alias("value"), (F.lit(1) if weight is None else weight).cast("long").alias("n"))
    return rows.mapInPandas(lambda batches: _sketch_rows(batches, groups), f"{_kinds(values, groups)}, total long, sketch binary")


def sketches(values: DataFrame, groups: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """One sketch per group: groups, total, sketch.

    Null, NaN, infinite and non-positive values do not count. ``weight``: how often a row counts; -1 takes a row out.
    """
    return merge_sketches(_partial(values, groups, value, weight), groups)


def merge_sketches(parts: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups as sums of the parts'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, s in _merged(batches, groups):
            yield pd.DataFrame([(*key, s.total, s.pack())], columns=[*groups, "total", "sketch"])

    return _together(parts, groups).mapInPandas(run, f"{_kinds(parts, groups)}, total long, sketch binary")


def _answer(s: Sketch, shares: list[float]) -> tuple:
    return (s.total, *(float(decode(s.code_at(q))) for q in shares), VALUE_ERROR, s.rank_error())


def _answers_schema(shares: list[float]) -> tuple[list[str], str]:
    names = [f"p{100 * q:g}".replace(".", "_") for q in shares]
    return ["n", *names, "value_error", "rank_error"], "n long, " + ", ".join(f"{x} double" for x in names) + ", value_error double, rank_error double"


def percentiles(sketched: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """The percentiles of sketches: groups, n, p.., value_error (relative), rank_error (share of n). Groups all of whose rows were taken out again have none."""
    names, kinds = _answers_schema(shares)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = ((k, Sketch.unpack(d)) for k, d in zip(batch[groups].itertuples(index=False, name=None), batch["sketch"]))
            yield pd.DataFrame([(*_key(k), *_answer(s, shares)) for k, s in held if s.total > 0], columns=[*groups, *names])

    return sketched.select(*groups, "sketch").mapInPandas(run, f"{_kinds(sketched, groups)}, {kinds}")


def percentiles_with_totals(values: DataFrame, groups: list[str], total: list[str], value: str, shares: list[float]) -> DataFrame:
    """Percentiles of ``groups`` and of the coarser ``total`` (a part of them) from one pass over the values.

    Each task answers for its own groups at once and adds their sketches up by ``total``; only those sums are shuffled.
    Rows of the totals have null in the other group columns and ``level`` total, those of the groups ``level`` group.
    """
    names, kinds = _answers_schema(shares)
    at = [groups.index(g) for g in total]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, Sketch] = {}
        rows: list[tuple] = []

        def parts() -> list[tuple]:
            out = []
            for coarse, s in sums.items():
                key = [None] * len(groups)
                for i, v in zip(at, coarse):
                    key[i] = v
                out.append(("part", *key, s.total, *[None] * (len(names) - 1), s.pack()))
            sums.clear()
            return out

        for key, s in _merged(batches, groups):
            rows.append(("group", *key, *_answer(s, shares), None))
            sums.setdefault(tuple(key[i] for i in at), Sketch()).merge(s)
            if len(sums) > 200:
                rows += parts()
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=["level", *groups, *names, "sketch"])
                rows = []
        yield pd.DataFrame(rows + parts(), columns=["level", *groups, *names, "sketch"])

    part = _together(_partial(values, groups, value), groups)
    both = stored(part.mapInPandas(run, f"level string, {_kinds(values, groups)}, {kinds}, sketch binary"))
    own = both.filter("level = 'group'").drop("sketch")
    sums = percentiles(merge_sketches(both.filter("level = 'part'").select(*total, "sketch"), total), total, shares)
    missing = [F.lit(None).cast(values.schema[g].dataType).alias(g) if g not in total else F.col(g) for g in groups]
    return own.unionByName(sums.select(F.lit("total").alias("level"), *missing, *names))


def trait_values(traits: DataFrame) -> DataFrame:
    """Eligible, finite, positive lengths and diameters, long: accession, root_order, day, metric, value.

    Of each (sample_id, root_id, run_no) the newest row by loaded_at counts, also where it is not eligible itself; exact
    repeats count once.
    """
    use = {m: F.when(F.col(f"{m}_measurement_eligible"), finite(m)) for m in ("length", "mean_diameter")}
    rows = traits.select("sample_id", "root_id", "run_no", "loaded_at", "accession", F.col("root_order").cast("int").alias("root_order"), F.col("measured_at").cast("date").alias("day"), *(F.when(v > 0, v).alias(m) for m, v in use.items()))
    now = rows.groupBy("sample_id", "root_id", "run_no").agg(F.max(F.struct("loaded_at", "accession", "root_order", "day", "length", "mean_diameter")).alias("r")).select("r.*")
    both = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("length", "mean_diameter")))
    return now.select("accession", "root_order", "day", F.explode(both).alias("m")).select("accession", "root_order", "day", "m.metric", "m.value").filter("value is not null")


SHARES = [0.1, 0.5, 0.9, 0.99]


def trait_percentiles(traits: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Percentiles of both metrics for each root_order (accession null, level total) and each accession and root_order.

    A null root_order is a group of its own. An empty table gives no rows.
    """
    return percentiles_with_totals(trait_values(traits), ["accession", "root_order", "metric"], ["root_order", "metric"], "value", shares)


def day_sketches(traits: DataFrame) -> DataFrame:
    """A sketch per day, root_order and metric, to be kept and combined (merge_sketches)."""
    return sketches(trait_values(traits), ["day", "root_order", "metric"], "value")


def percentiles_over_days(traits: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Percentiles per root_order and metric from the sketches of single days, added up."""
    keys = ["root_order", "metric"]
    return percentiles(merge_sketches(day_sketches(traits), keys), keys, shares)


def check_percentiles(traits: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Each row of ``trait_percentiles`` held against the exact ranks of all values: level, accession, root_order, metric, n, and per share whether it is within its stated errors."""
    answers = trait_percentiles(traits, shares)
    names = _answers_schema(shares)[0][1:-2]
    keys = ["level", "accession", "root_order", "metric"]
    v = trait_values(traits).select("accession", "root_order", "metric", "value")
    v = v.select(F.explode(F.array(F.struct(F.lit("group").alias("level"), "accession"), F.struct(F.lit("total").alias("level"), F.lit(None).cast("string").alias("accession")))).alias("g"), "root_order", "metric", "value").select("g.level", "g.accession", "root_order", "metric", "value")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    half = 1.01 * VALUE_ERROR
    held = v.alias("v").join(answers.alias("a"), same).groupBy(*(F.col(f"a.{k}") for k in keys), "a.n", "a.rank_error").agg(
        *(F.count_if(F.col("v.value") < F.col(f"a.{p}") * (1 - half)).alias(f"lt_{p}") for p in names), *(F.count_if(F.col("v.value") <= F.col(f"a.{p}") * (1 + half)).alias(f"le_{p}") for p in names)
    )
    checks = []
    for p, q in zip(names, shares):
        target, slack = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9)), F.col("rank_error") * F.col("n") + 1e-6
        checks.append(((F.col(f"lt_{p}") + 1 - target <= slack) & (target - F.col(f"le_{p}") <= slack)).alias(f"{p}_holds"))
    return held.select(*keys, "n", *checks)
