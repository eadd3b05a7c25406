"""Lengths recorded in different units: unit changes found in histories, evidence read, values converted.

``label_histories`` cuts the history of a sample into segments of equal unit by an exact penalised changepoint search on the
logarithms; the levels are those of the known factors, which are the units of length and the factor with which a record
says that it was calibrated. Each segment has the factor that reverses its shift. ``read_units`` reads what a record says
of its own unit, which fixes the base of the levels and comes before the segment; the segment converts what it leaves open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborline.common import finite, stored
from arborline.operators.scan import range_blocks, rows_by_key

# The units of length in millimetres, and the words that name them (lower case, without a final point).
MM_PER_UNIT = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "um": 1e-3, "nm": 1e-6, "inch": 25.4}
UNIT_WORDS = {
    "mm": ("mm", "millimeter", "millimeters", "millimetre", "millimetres"),
    "cm": ("cm", "centimeter", "centimeters", "centimetre", "centimetres"),
    "m": ("m", "meter", "meters", "metre", "metres"),
    "um": ("um", "µm", "μm", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres"),
    "nm": ("nm", "nanometer", "nanometers", "nanometre", "nanometres"),
    "inch": ("in", "inch", "inches"),
}

#: Words for what coordinates are given as; a unit counts in a remark if its clause begins by speaking of them.
COORDINATE_WORDS = ("coordinates?", "xyz", "numbers?", "axes", "axis", "units?", "mesh", "model", "vertices", "points", "values", "geometry")

#: Factors that differ by less than this share agree.
AGREE = 1e-6

_UNIT = "|".join(sorted((w for ws in UNIT_WORDS.values() for w in ws), key=len, reverse=True))
_NUMBER = r"[-+]?(?:[0-9]+(?:[ \u00a0\u202f'][0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?"


def unit_factor(word: Column) -> Column:
    """Millimetres per unit that a word (in any spelling, with a point or not) names; null if none."""
    w = F.regexp_replace(F.lower(F.regexp_replace(word, r"^[\s\u00a0]+|[\s\u00a0.]+$", "")), "^\\[|\\]$", "")
    pairs = [F.lit(x) for u, ws in UNIT_WORDS.items() for w_ in ws for x in (w_, MM_PER_UNIT[u])]
    return F.element_at(F.create_map(*pairs), w)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(F.length(x) > 0, x)


def declared_word(declaration: Column) -> Column:
    """The word after ``unit`` or ``units`` in a free declaration (``[unit:mm]``, ``UNITS = cm.``, ``Unit : m; rev 2``)."""
    return _found(declaration, r"(?i)\bunits?\s*[:=]\s*([^\s;,\]\)]+)")


def remark_word(remark: Column) -> Column:
    """The unit in which a remark says the coordinates are; lengths of other things (``pot 9 cm``) do not count."""
    about = "|".join(COORDINATE_WORDS)
    return _found(remark, rf"(?i)(?:^|[;,.]\s*)(?:the\s+|all\s+|export\s+)*(?:{about})\b(?:(?![0-9])[^;,])*?\s\(?({_UNIT}|px|pixels?|voxels?|grid|unitless|au|\?)\)?\.?\s*(?:$|[;,.])")


def scale_number(scale_text: Column) -> Column:
    """The number in a text: a comma is a decimal mark, blanks group digits."""
    raw = _found(scale_text, f"({_NUMBER})")
    return F.regexp_replace(F.regexp_replace(raw, r"[ \u00a0\u202f']", ""), ",", ".").try_cast("double")


def scale_word(scale_text: Column) -> Column:
    """What follows the number in a text, as a unit's name."""
    return _found(scale_text, rf"{_NUMBER}\s*\(?\s*([^\s\)\(;0-9]+)")


def read_units(calibrations: DataFrame) -> DataFrame:
    """Each record once, with what it says of its unit.

    Adds ``number`` (of ``scale``, else of ``scale_text``), ``frame_factor`` (of ``coordinate_unit``), ``factors`` (the
    millimetres per unit that the pieces of evidence name), ``unnamed`` (pieces that name no unit of length),
    ``evidence`` (number of pieces) and ``factor``: the one that holds, null if there is none or if they disagree.
    NaN, infinite, zero and negative factors are no evidence. A unit word counts in any case, with or without a point.
    """
    rows = calibrations.select("calibration_id", "sample_id", "recorded_at", "source", "mm_per_mesh_unit", "declared_unit", "raw_declaration", "coordinate_unit", "minimum_x", "minimum_y", "minimum_z", "scale", "scale_text", "remark").distinct()
    mesh = finite("mm_per_mesh_unit")
    mesh = F.when(mesh > 0, mesh)
    words = [
        F.when(F.trim("declared_unit") != "", F.col("declared_unit")),
        declared_word(F.col("raw_declaration")),
        remark_word(F.col("remark")),
        scale_word(F.col("scale_text")),
    ]
    said = F.array_compact(F.array(*words))
    factors = F.array_compact(F.array(mesh, *[unit_factor(w) for w in words]))
    rows = rows.select(
        "*",
        F.coalesce(F.when(~F.isnan("scale"), F.col("scale")), scale_number(F.col("scale_text"))).alias("number"),
        unit_factor(F.col("coordinate_unit")).alias("frame_factor"),
        factors.alias("factors"),
        F.size(F.filter(said, lambda w: unit_factor(w).isNull())).alias("unnamed"),
        (F.size(said) + F.when(mesh.isNotNull(), 1).otherwise(0)).alias("evidence"),
    )
    low, high = F.array_min("factors"), F.array_max("factors")
    agreed = F.when((F.size("factors") > 0) & (F.col("unnamed") == 0) & (high - low <= AGREE * high), F.col("factors")[0])
    return rows.withColumn("factor", F.coalesce("frame_factor", agreed))


def convert_extents(calibrations: DataFrame) -> DataFrame:
    """All records in millimetres: extent, minimum corner, and what became of each record.

    ``outcome``: as_it_stands, converted, no_evidence, no_unit (a word that names no unit of length), contradiction,
    no_number. Lengths of records that cannot be converted are null. Exact repeats count once.
    """
    return _outcomes(read_units(calibrations)).drop("calibrated", *_CORNER)


_CORNER = ("minimum_x", "minimum_y", "minimum_z")


def _outcomes(r: DataFrame) -> DataFrame:
    outcome = (
        F.when(F.col("number").isNull(), "no_number")
        .when(F.col("factor").isNotNull(), F.when(F.abs(F.col("factor") - 1) <= AGREE, "as_it_stands").otherwise("converted"))
        .when(F.col("evidence") == 0, "no_evidence")
        .when(F.size("factors") == 0, "no_unit")
        .otherwise("contradiction")
    )
    own = [finite(c).alias(c) for c in _CORNER]
    mm = [(finite(c) * F.col("factor")).alias(c + "_mm") for c in _CORNER]
    mesh = finite("mm_per_mesh_unit")
    return r.select("calibration_id", "sample_id", "recorded_at", "source", "number", "factor", F.when(mesh > 0, mesh).alias("calibrated"), *own, (finite("number") * F.col("factor")).alias("extent_mm"), *mm, outcome.alias("outcome"))


def convert_histories(calibrations: DataFrame) -> DataFrame:
    """All records in millimetres, also those whose own evidence leaves the unit open, by the segments of their histories.

    The columns of ``convert_extents`` with ``history_factor`` and ``shift`` of the record's segment (``label_histories``).
    ``decided_by``: ``segment`` where the evidence names the factor of the segment, ``evidence`` where it names another
    (``overruled``) or the record has no positive number and so no history; null where it names none, contradicts itself or
    is not there, so that ``extent_mm`` is null. ``likely_factor`` is that of the evidence, else that of the segment;
    ``likely_extent_mm`` and the ``likely_minimum`` columns are the lengths by it, null only without a number or both factors.
    """
    r = stored(_outcomes(read_units(calibrations)))
    measured = (F.col("number") > 0) & (F.col("number") < float("inf")) & F.col("sample_id").isNotNull()
    found = label_histories(r.filter(measured)).withColumnRenamed("unit_factor", "history_factor")
    none = F.lit(None).cast("double")
    rest = r.filter(~F.coalesce(measured, F.lit(False))).withColumn("history_factor", none).withColumn("shift", none)
    agrees = F.abs(F.col("history_factor") - F.col("factor")) <= AGREE * F.col("factor")
    decided = F.when(F.col("factor").isNotNull(), F.when(F.coalesce(agrees, F.lit(False)), "segment").otherwise("evidence"))
    out = found.unionByName(rest).withColumn("decided_by", decided).withColumn("overruled", F.col("history_factor").isNotNull() & (F.col("decided_by") == "evidence"))
    likely = F.coalesce("factor", "history_factor")
    lengths = {"likely_extent_mm": finite("number") * likely} | {f"likely_{c}_mm": F.col(c) * likely for c in _CORNER}
    return out.withColumns({"likely_factor": likely, **lengths}).drop("calibrated", *_CORNER)


def unit_cases(calibrations: DataFrame) -> DataFrame:
    """``calibration_id, extent_um`` of the records whose number is not in mm as it stands; -1 if it cannot be told.

    A case is what the record says of itself. Histories have no say: where they name a unit that the record does not, the
    case is still -1 (``convert_histories`` has the likely extent).
    """
    r = convert_extents(calibrations).filter("outcome not in ('no_number', 'as_it_stands')")
    return r.select("calibration_id", F.coalesce(F.round(F.col("extent_mm") * 1000).cast("long"), F.lit(-1).cast("long")).alias("extent_um"))


#: Spread of the logarithms (base e) within a unit, and the cost of a change of unit, for the changepoint search.
SPREAD, PENALTY = 0.05, 4.0

#: Cost of a record that fits no unit (its squared deviation is cut there).
OUTLIER = 40.0

_FACTORS = list(MM_PER_UNIT.values())
_LEVELS = [-math.log(f) for f in _FACTORS]


def emission(log_value: float, base: float, log_calibrated: float) -> list[float]:
    """The cost of a record at each unit's level, and last at that of its own calibration (NaN: none); ``base`` is the logarithm of the extent in mm."""
    x = log_value - base
    own = (x + log_calibrated) / SPREAD
    return [min(((x - level) / SPREAD) ** 2, OUTLIER) for level in _LEVELS] + [min(own * own, OUTLIER) if own == own else 3 * OUTLIER]


def step(cost: list[float], e: list[float], penalty: float) -> list[float]:
    """One step of the exact dynamic programme: stay, or change at the price of a penalty."""
    change = min(cost) + penalty
    return [min(c, change) + x for c, x in zip(cost, e)]


def _least(cost: list[float]) -> int:
    return cost.index(min(cost))


def unit_segments(calibrations: DataFrame, penalty: float = PENALTY, blocks: int | None = None) -> DataFrame:
    """``label_histories`` of all records with a positive number: calibration_id, sample_id, recorded_at, number, unit_factor, shift, declared_factor."""
    kept = (F.col("number") > 0) & (F.col("number") < float("inf")) & F.col("sample_id").isNotNull()
    r = stored(_outcomes(read_units(calibrations)).filter(kept).select("calibration_id", "sample_id", "recorded_at", "number", "factor", "calibrated"))
    return label_histories(r, penalty, blocks).withColumnRenamed("factor", "declared_factor").select("calibration_id", "sample_id", "recorded_at", "number", "unit_factor", "shift", "declared_factor")


def label_histories(records: DataFrame, penalty: float = PENALTY, blocks: int | None = None) -> DataFrame:
    """The unit of each record of a sample's history, found from the levels of the numbers.

    The cost of a labelling is the sum of squared deviations of log values from the level of their unit plus a penalty
    per change; the least one is exact (min-plus dynamic programme over all labellings). Levels are those of the known
    units, and one at which a number times its record's own ``calibrated`` factor is the base. Each block of a history is
    a min-plus matrix, so a long history is cut over many tasks and its blocks composed: forward and backward costs that
    come into a block give the same labels as one pass. The base of a sample, the median log extent, comes from records
    with agreed evidence; where a sample has none, the median of its log values stands for it. ``records``: sample_id,
    recorded_at, calibration_id, number (positive), factor (of the evidence or null), calibrated (mm per unit or null) and
    further columns, which are kept; it is read twice. Adds ``unit_factor`` and ``shift`` (the factor against the record
    before; 1 for none).
    """
    n = len(_LEVELS) + 1
    r = records.withColumn("_x", F.log("number"))
    base = r.groupBy("sample_id").agg(F.coalesce(F.percentile_approx(F.col("_x") + F.log("factor"), 0.5, 1000), F.percentile_approx("_x", 0.5, 1000)).alias("_base"))
    rows = range_blocks(r.withColumn("_c", F.log("calibrated")).join(base, "sample_id"), "sample_id", ["recorded_at", "calibration_id"], blocks)

    def cost_of(row: dict) -> list[float]:
        own = row["_c"]
        return emission(row["_x"], row["_base"], math.nan if own is None else own)

    def matrix(own: list[list[float]]) -> list[float]:
        """The least cost from each unit before a stretch to each unit at its end."""
        lines = [[0.0 if j == k else math.inf for k in range(n)] for j in range(n)]
        for e in own:
            lines = [step(line, e, penalty) for line in lines]
        return [v for line in lines for v in line]

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The matrices of the first and the last history of a partition; those between lie in it as a whole."""
        out: list[tuple[Any, list[float], float]] = []
        last: tuple[Any, list, float] | None = None
        for k, own in rows_by_key(batches, "sample_id"):
            held, calibrated = [], math.nan
            for row in own:
                held.append(cost_of(row))
                calibrated = row["calibrated"]
            if out:
                last = (k, held, calibrated)
            else:
                out.append((k, matrix(held), calibrated))
        if last is not None:
            out.append((last[0], matrix(last[1]), last[2]))
        if out:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()] * len(out), "k": [x[0] for x in out], "m": [x[1] for x in out], "c": [x[2] for x in out]})

    found = sorted(rows.mapInPandas(edges, "part int, k string, m array<double>, c double").collect(), key=lambda e: (e["part"]))
    by_part: dict[int, list[tuple[Any, np.ndarray, float | None]]] = {}
    for e in found:
        by_part.setdefault(e["part"], []).append((e["k"], np.array(e["m"]).reshape(n, n), e["c"]))
    into: dict[int, tuple[Any, np.ndarray, float | None]] = {}
    state: tuple | None = None
    for p in sorted(by_part):
        if state is not None:
            into[p] = state
        k, m, c = by_part[p][-1]
        before = state[1] if state is not None and state[0] == k and len(by_part[p]) == 1 else None
        state = (k, m.min(axis=0) if before is None else (before[:, None] + m).min(axis=0), c)
    after: dict[int, tuple[Any, np.ndarray]] = {}
    state = None
    for p in sorted(by_part, reverse=True):
        if state is not None:
            after[p] = state
        k, m, _ = by_part[p][0]
        later = state[1] if state is not None and state[0] == k and len(by_part[p]) == 1 else np.zeros(n)
        state = (k, (m + later[None, :]).min(axis=1))
    handed = r.sparkSession.sparkContext.broadcast((into, after))

    kept = records.columns
    names = [*kept, "unit_factor", "shift"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = TaskContext.get().partitionId()
        into_p, after_p = handed.value[0].get(p), handed.value[1].get(p)
        out: list[tuple] = []
        for k, own in rows_by_key(batches, "sample_id"):
            held = list(own)  # the part of a history in one block
            forward, cost = [], into_p[1].tolist() if into_p is not None and into_p[0] == k else None
            for row in held:
                e = cost_of(row)
                cost = e if cost is None else step(cost, e, penalty)
                forward.append(cost)
            late = after_p[1].tolist() if after_p is not None and after_p[0] == k else [0.0] * n
            path = [_least([a + b for a, b in zip(forward[-1], late)])]
            for i in range(len(held) - 2, -1, -1):
                s, t = path[-1], _least(forward[i])
                path.append(s if forward[i][s] <= forward[i][t] + penalty else t)
            path.reverse()
            before = None
            if into_p is not None and into_p[0] == k:  # the unit of the record before this block
                t = int(np.argmin(into_p[1]))
                t = path[0] if into_p[1][path[0]] <= into_p[1][t] + penalty else t
                before = _FACTORS[t] if t < len(_FACTORS) else into_p[2]
            for row, s in zip(held, path):
                own = _FACTORS[s] if s < len(_FACTORS) else row["calibrated"]
                out.append((*(row[c] for c in kept), own, 1.0 if before is None else own / before))
                before = own
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(label, ", ".join(f"`{c}` {kind}" for c, kind in records.dtypes) + ", unit_factor double, shift double")


def segments(labelled: DataFrame) -> DataFrame:
    """The runs of equal unit of each sample: sample_id, segment, from_at, to_at, records, unit_factor, geometric mean of the extents in mm.

    Segment numbers count the shifts up to a record; the running count is made per sample and day first, so that a
    window goes over a sample's days with shifts and not over its records.
    """
    from pyspark.sql import Window as W

    day = F.col("recorded_at").cast("date")
    shifts = labelled.withColumn("day", day).withColumn("cut", (F.abs(F.log("shift")) > 1e-9).cast("int"))
    per_day = shifts.groupBy("sample_id", "day").agg(F.sum("cut").alias("n"))
    before = per_day.select("sample_id", "day", (F.sum("n").over(W.partitionBy("sample_id").orderBy("day")) - F.col("n")).alias("past"))
    w = W.partitionBy("sample_id", "day").orderBy("recorded_at", "calibration_id")
    rows = shifts.withColumn("within", F.sum("cut").over(w)).join(before, ["sample_id", "day"]).withColumn("segment", F.col("past") + F.col("within"))
    return rows.groupBy("sample_id", "segment").agg(
        F.min("recorded_at").alias("from_at"), F.max("recorded_at").alias("to_at"), F.count("*").alias("records"), F.max("unit_factor").alias("unit_factor"),
        F.exp(F.avg(F.log(F.col("number") * F.col("unit_factor")))).alias("mean_extent_mm"),
    )
