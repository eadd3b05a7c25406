from datetime import datetime

import numpy as np
import pytest

from arborline.operators import quantiles as q


def held(s, values, shares=(0.01, 0.1, 0.5, 0.9, 0.99)):
    x = np.sort(values)
    for share in shares:
        v = float(q.decode(s.code_at(share)))
        low, high = np.searchsorted(x, v * (1 - 1.01 * q.VALUE_ERROR)), np.searchsorted(x, v * (1 + 1.01 * q.VALUE_ERROR), "right")
        target = max(1, np.ceil(share * len(x)))
        assert max(0, low + 1 - target, target - high) <= s.rank_error() * len(x)


@pytest.mark.parametrize("n", [1, 10, 1000, 50_000, 400_000])
def test_rank_error(n):
    v = np.random.default_rng(n).lognormal(2, 1, n)
    s = q.Sketch().add(q.encode(v))
    held(s, v)
    assert s.rank_error() <= 0.01 and (n > 2000 or s.rank_error() == 0) and (n < 50_000 or len(s.fine) >= 3)


def test_heavy_values_do_not_widen_the_bound():
    rng = np.random.default_rng(5)
    v = np.r_[np.full(60_000, 3.25), rng.lognormal(2, 1.5, 100_000)]
    s = q.Sketch().add(q.encode(v))
    held(s, v)
    assert s.rank_error() < 0.01


def test_every_double_has_a_code():
    v = np.array([5e-324, 2.3e-308, 1e-30, 0.5, 1.0, 7.7, 1e30, 1.79e308])
    codes = q.encode(v)
    assert (np.diff(codes) > 0).all() and codes.min() >= 0 and codes.max() < 2**q.BITS
    assert (np.abs(q.decode(codes[1:]) / v[1:] - 1) <= q.VALUE_ERROR).all()


def test_merge_and_deletion():
    rng = np.random.default_rng(1)
    a, b = q.encode(rng.lognormal(1, 1, 50_000)), q.encode(rng.lognormal(3, 0.5, 30_000))
    one = q.Sketch().add(np.r_[a, b])
    parts = [q.Sketch().add(x) for x in np.array_split(np.r_[a, b], 97)]
    assert parts[0].exact == q.BITS and one.exact < q.BITS
    two = q.Sketch()
    for p in parts:
        two.merge(q.Sketch.unpack(p.pack()))
    three = q.Sketch().add(b).merge(q.Sketch().add(a))
    for other in (two, three):
        assert one.exact == other.exact and all(np.array_equal(one.fine[k], other.fine[k]) for k in one.fine) and np.array_equal(one.cells, other.cells) and np.array_equal(one.counts, other.counts)
    alone = q.Sketch().add(a)._coarsen(one.exact)
    for back in (two.add(b, -np.ones(len(b))), one.merge(q.Sketch().add(b), -1)):
        assert back.exact == alone.exact and all(np.array_equal(back.fine[k], alone.fine[k]) for k in alone.fine) and back.total == len(a)


KIND = "sample_id string, root_id string, run_no int, loaded_at timestamp, accession string, root_order int, measured_at timestamp, length double, length_measurement_eligible boolean, mean_diameter double, mean_diameter_measurement_eligible boolean, metric string, code int, n long"


def row(i, length, diameter=1.0, ok=True, order=1, accession="a", load=1, day=1):
    return ("s", f"r{i}", 1, datetime(2024, 1, load), accession, order, datetime(2024, 1, day), length, ok, diameter, True, "clash", 1, 1)


def test_traits(spark):
    rows = [row(i, float(i + 1), accession="a" if i % 3 else "b", day=1 + i % 5) for i in range(200)]
    rows += [row(0, 1.0, accession="b"), row(500, float("nan")), row(501, -1.0), row(502, 0.0), row(503, float("inf")), row(504, 7.0, ok=False), row(505, None), row(506, 5.0, order=None)]
    rows += [row(1, 1e9, load=1), row(1, 2.0, load=2, ok=False, day=2)]  # the newest row of r1 is not eligible
    df = spark.createDataFrame(rows, KIND)
    got = {(r["level"], r["accession"], r["root_order"], r["metric"]): r for r in q.trait_percentiles(df).collect()}
    total = got["total", None, 1, "length"]
    assert total["n"] == 199 and total["p50"] == pytest.approx(101, abs=2) and total["p99"] == pytest.approx(198, abs=3)
    assert got["group", "a", None, "length"]["n"] == 1 and got["total", None, None, "length"]["p50"] == pytest.approx(5, rel=1e-3)
    assert got["group", "a", 1, "length"]["n"] + got["group", "b", 1, "length"]["n"] == 199
    days = {(r["root_order"], r["metric"]): r for r in q.percentiles_over_days(df).collect()}
    assert all(r[f"p{p}_holds"] for r in q.check_percentiles(df).collect() for p in (10, 50, 90, 99)) and q.check_percentiles(df).count() == len(got)
    assert days[1, "length"]["p50"] == total["p50"] and days[1, "length"]["n"] == 199


def test_empty_and_null(spark):
    none = spark.createDataFrame([(None,) * 14], KIND)
    for df in (none, none.limit(0)):
        assert q.trait_percentiles(df).count() == 0 and q.percentiles_over_days(df).count() == 0


def test_rows_can_be_taken_out(spark):
    df = spark.createDataFrame([("a", float(i), 1) for i in range(1, 101)] + [("a", float(i), -1) for i in range(51, 101)] + [("b", 1.0, 1), ("b", 1.0, -1)], "g string, x double, w int")
    rows = q.percentiles(q.sketches(df, ["g"], "x", df["w"]), ["g"], [0.5]).collect()
    assert [(r["g"], r["n"]) for r in rows] == [("a", 50)] and rows[0]["p50"] == pytest.approx(25, rel=1e-3)
