from datetime import datetime, timedelta

import pytest

from arborline.operators import units

KIND = "calibration_id long, sample_id string, recorded_at timestamp, source string, mm_per_mesh_unit double, declared_unit string, raw_declaration string, coordinate_unit string, minimum_x double, minimum_y double, minimum_z double, scale double, scale_text string, remark string, factor string, number string"
FIELDS = [x.split()[0] for x in KIND.split(", ")]


def records(spark, *given):
    t = datetime(2024, 1, 1)
    rows = [tuple(({"calibration_id": i, "sample_id": "s", "recorded_at": t + timedelta(days=i), "factor": "clash", "number": "clash"} | g).get(f) for f in FIELDS) for i, g in enumerate(given)]
    return spark.createDataFrame(rows, KIND)


CASES = [
    ({"scale": 5.0, "declared_unit": "CM."}, 50_000),
    ({"scale": 5.0, "declared_unit": "mm"}, None),
    ({"scale": 5.0, "coordinate_unit": " MM", "declared_unit": "cm"}, None),
    ({"scale": 2.0, "coordinate_unit": "Metre", "declared_unit": "cm"}, 2_000_000),
    ({"scale": 5.0, "mm_per_mesh_unit": 27.5}, 137_500),
    ({"scale": 5.0, "mm_per_mesh_unit": float("nan"), "declared_unit": "µm"}, 5),
    ({"scale": 5.0, "mm_per_mesh_unit": -1.0}, -1),
    ({"scale": 5.0, "mm_per_mesh_unit": float("inf")}, -1),
    ({"scale": 5.0, "mm_per_mesh_unit": 10.0, "raw_declaration": "[unit:mm.] root scan"}, -1),
    ({"scale": 5.0, "mm_per_mesh_unit": 10.0, "raw_declaration": "UNITS = cm."}, 50_000),
    ({"scale": 5.0, "declared_unit": "px"}, -1),
    ({"scale": 5.0, "remark": "pot 9 cm"}, -1),
    ({"scale": 5.0, "remark": "pot 9 cm; xyz are inches"}, 127_000),
    ({"scale": 5.0, "remark": "model unit microns, lens 50 mm"}, 5),
    ({"scale_text": "extent 7,5 Inch"}, 190_500),
    ({"scale_text": "~ 94 775 microns"}, 94_775),
    ({"scale_text": "82,965mm."}, None),
    ({"scale_text": "0.5 (M)", "declared_unit": "cm"}, -1),
    ({}, None),
    ({"scale": 5.0}, -1),
]


def test_evidence(spark):
    got = dict(map(tuple, units.unit_cases(records(spark, *(g for g, _ in CASES))).collect()))
    assert got == {i: v for i, (_, v) in enumerate(CASES) if v is not None}


def test_repeats_nulls_and_empty(spark):
    r = records(spark, {"scale": 5.0, "declared_unit": "cm"})
    assert units.unit_cases(r.union(r)).count() == 1
    none = spark.createDataFrame([(None,) * len(FIELDS)], KIND)
    for f in (units.unit_cases, units.convert_extents, units.unit_segments, units.convert_histories):
        assert f(none.limit(0)).count() == 0
        f(none).count()


@pytest.mark.parametrize("blocks", [1, 6])
def test_segments_are_exact_and_blocks_agree(spark, blocks):
    units_ = ["mm"] * 6 + ["um"] * 5 + ["cm"] * 4 + ["mm"] * 3 + ["inch"] * 3
    given = [{"scale": 150.0 * (1 + 0.02 * (i % 3 - 1)) / units.MM_PER_UNIT[u], "sample_id": "a"} | ({"declared_unit": u} if i < 4 else {}) for i, u in enumerate(units_)]
    given += [{"scale": 80.0, "declared_unit": "mm", "sample_id": s} for s in "bcdef"]
    got = {r["calibration_id"]: r for r in units.unit_segments(records(spark, *given), blocks=blocks).collect()}
    assert [got[i]["unit_factor"] for i in range(len(units_))] == [units.MM_PER_UNIT[u] for u in units_]
    assert [i for i in range(len(units_)) if got[i]["shift"] != 1.0] == [6, 11, 15, 18]
    assert got[6]["shift"] == pytest.approx(1e-3)
    assert units.segments(units.unit_segments(records(spark, *given), blocks=blocks)).filter("sample_id = 'a'").count() == 5


def test_segments_decide_and_evidence_overrules(spark):
    given = [{"scale": 150.0, "declared_unit": "mm"}] * 4 + [{"scale": 15.0, "declared_unit": "cm"}] * 3 + [{"scale": 15.01}, {"scale": 15.02, "declared_unit": "inch"}, {"scale": 150.0 / 32.08, "mm_per_mesh_unit": 32.08}, {"scale": 150.0 / 0.47, "mm_per_mesh_unit": 0.47}]
    rows = {r["calibration_id"]: r for r in units.convert_histories(records(spark, *given)).collect()}
    assert [rows[i]["history_factor"] for i in range(11)] == [1.0] * 4 + [10.0] * 5 + [32.08, 0.47]
    assert [rows[i]["decided_by"] for i in range(11)] == ["segment"] * 7 + [None, "evidence", "segment", "segment"] and rows[8]["overruled"]
    assert rows[4]["shift"] == 10.0 and rows[9]["shift"] == pytest.approx(3.208) and rows[8]["extent_mm"] == pytest.approx(15.02 * 25.4)
    assert rows[9]["extent_mm"] == pytest.approx(150.0) and rows[7]["extent_mm"] is None


@pytest.mark.parametrize("blocks", [1, 5, 11])
def test_calibrations_of_their_own_agree_over_blocks(spark, blocks):
    given = [{"scale": 90.0 / f * (1 + 0.01 * (i % 3 - 1)), "mm_per_mesh_unit": f, "sample_id": "ab"[i > 30]} for i, f in enumerate([1.0, 32.08, 32.08, 0.47, 10.0, 10.0, 6.7, 6.7, 6.9, 1.0] * 4)]
    got = {r["calibration_id"]: r for r in units.unit_segments(records(spark, *given), blocks=blocks).collect()}
    assert [got[i]["unit_factor"] for i in range(40)] == [g["mm_per_mesh_unit"] for g in given]
    assert got[2]["shift"] == 1.0 and got[3]["shift"] == pytest.approx(0.47 / 32.08) and got[31]["shift"] == 1.0


def test_segments_convert_what_the_evidence_leaves_open(spark):
    given = [{"scale": 150.0, "declared_unit": "mm"}] * 4 + [{"scale": 15.0, "declared_unit": "cm"}] * 2
    given += [{"scale": 15.01, "minimum_x": -2.0, "minimum_y": float("nan")}, {"scale": 15.02, "declared_unit": "cm", "mm_per_mesh_unit": 1.0}, {"scale": 15.03, "declared_unit": "px"}, {"scale": 15.04, "declared_unit": "inch", "minimum_x": -1.0}]
    given += [{"scale": 0.0}, {"scale": 3.0, "sample_id": None, "declared_unit": "cm"}, {"scale": 3.0, "sample_id": None}, {}]
    rows = {r["calibration_id"]: r for r in units.convert_histories(records(spark, *given)).collect()}
    assert [rows[i]["outcome"] for i in (6, 7, 8)] == ["no_evidence", "contradiction", "no_unit"] and [rows[i]["extent_mm"] for i in (6, 7, 8)] == [None] * 3
    assert [rows[i]["likely_extent_mm"] for i in range(10)] == pytest.approx([150.0] * 6 + [150.1, 150.2, 150.3, 15.04 * 25.4])
    assert rows[6]["likely_minimum_x_mm"] == pytest.approx(-20.0) and rows[6]["likely_minimum_y_mm"] is None and rows[9]["likely_minimum_x_mm"] == pytest.approx(-25.4)
    assert [rows[i]["likely_extent_mm"] for i in (10, 11, 12, 13)] == [None, 30.0, None, None]


def test_cases_do_not_run_the_histories(spark, monkeypatch):
    monkeypatch.delattr(units, "label_histories")
    assert [tuple(r) for r in units.unit_cases(records(spark, {"scale": 5.0, "declared_unit": "cm"}, {"scale": 5.0})).orderBy("calibration_id").collect()] == [(0, 50_000), (1, -1)]
