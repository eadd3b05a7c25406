import math

import numpy as np
import pytest

from arborline.llm import mixture as m

DOCS = "doc_id long, text string, source string, copies int, rate double"
TARGETS = "source string, target_share double, max_repeats double"


def tables(spark):
    docs = [(i, f"Some words about the number {i}, " * (1 + i % 7), ["big", " BIG", "other one", "Other_One ", "small"][i % 5] if i < 900 else "small", 1, 1.0) for i in range(1000)]
    docs += [(2000, None, "big", 1, 1.0), (2001, "", "big", 1, 1.0), (2002, "x y", None, 1, 1.0), (2003, "x y", "not wanted", 1, 1.0), (None, "x y", "big", 1, 1.0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([("big", 0.3, 1.0), ("other_one", 0.2, 2.0), ("Small", 0.4, 5.0), ("absent", 0.1, 3.0)], TARGETS)


def test_shares_and_caps(spark):
    docs, targets = tables(spark)
    mixed, report = m.mixture(docs, targets)
    r = {x["source"]: x for x in report.collect()}
    for s, share in (("big", 0.3), ("other_one", 0.2), ("small", 0.4)):
        assert r[s]["reached_share"] == pytest.approx(share / 0.9, abs=0.02)
    assert r["absent"]["tokens"] == 0 and sum(x["reached_share"] for x in r.values()) == pytest.approx(1)
    rows = mixed.collect()
    assert len(rows) == sum(x["copies"] for x in r.values()) and sum(x["n_tokens"] for x in rows) == sum(x["tokens"] for x in r.values())
    for s, cap in (("big", 1), ("other_one", 2), ("small", 5)):
        assert max(x["copy"] for x in rows if x["source"] == s) <= cap
    assert len({(x["doc_id"], x["copy"]) for x in rows}) == len(rows) and not {x["doc_id"] for x in rows} & {2000, 2001, 2002, 2003, None}
    order = [x["doc_id"] for x in rows]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1
    again, _ = m.mixture(docs.repartition(7), targets)
    assert {(x["doc_id"], x["copy"]) for x in again.collect()} == {(x["doc_id"], x["copy"]) for x in rows}


def test_given_total(spark):
    docs, targets = tables(spark)
    _, report = m.mixture(docs, targets, total_tokens=3000)
    assert sum(x["tokens"] for x in report.collect()) == pytest.approx(3000, rel=0.1)
    _, most = m.mixture(docs, targets, total_tokens=1e9)
    assert {x["source"]: x["rate"] for x in most.collect()} == {"big": 1.0, "other_one": 2.0, "small": 5.0, "absent": 0.0}


def test_empty(spark):
    docs, targets = tables(spark)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        mixed, report = m.mixture(d, t)
        assert mixed.count() == 0 and report.count() == t.count()


@pytest.mark.parametrize("rate,cap", [(0.3, 1), (0.99, 1), (1.7, 2), (2.4, 6), (0.01, 50), (30.0, 200)])
def test_cut_poisson(rate, cap):
    table = m.cut_poisson(rate, cap)
    assert sum(1 - x for x in table) == pytest.approx(rate, rel=1e-6) and table == sorted(table) and len(table) <= cap
    if cap > 3 * rate + 3:  # hardly cut: a Poisson distribution
        assert table[0] == pytest.approx(math.exp(-rate), rel=0.05)
    assert m.cut_poisson(5, 5) == [0.0] * 5 and m.cut_poisson(0, 3) == [1.0]


def test_token_counts(spark):
    tiktoken = m._encoding(m.VOCABULARY)
    long = "line of text\n" * 100_000
    got = {r["doc_id"]: r["n_tokens"] for r in m.count_tokens(spark.createDataFrame([(1, "Hello <|endoftext|> world", "a"), (2, None, "a"), (3, long, None)], "doc_id long, text string, source string")).collect()}
    assert got[1] == len(tiktoken.encode_ordinary("Hello <|endoftext|> world")) and got[2] == 0 and got[3] == 100_000 * len(tiktoken.encode_ordinary("line of text\n"))


def test_long_texts_count_as_a_whole(spark):
    text = "def f(x):\n\n\n        return x  \n \t\n    if it's 12,5:\n\n\u00a0 y\r\n\r\n" * 20_000
    assert len(text) > 10 * m.PIECE and "".join(m.pieces(text)) == text and len(list(m.pieces(text))) > 5
    rows = m.count_tokens(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).collect()
    assert rows[0]["n_tokens"] == len(m._encoding(m.VOCABULARY).encode_ordinary(text))
