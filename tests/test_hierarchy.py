import random
from datetime import datetime

import pytest

from arborline.operators import hierarchy, tree

KIND = "sample_id string, root_id string, parent_id string, root_order int, recorded_at timestamp, insertion_index int, confidence double, depth long, kind string, key string"
T = datetime(2024, 1, 1)


def roots(spark, links, sample="s", order=None):
    return spark.createDataFrame([(sample, r, p, (order or {}).get(r), T, i, 0.5 + i / 1000, 9, "clash", "clash") for i, (r, p) in enumerate(links)], KIND)


def test_faults(spark):
    df = roots(spark, [("primary", None), ("a", " PRIMARY "), ("b", "A"), ("c", "d"), ("d", "c"), ("e", "d"), ("f", "e"), ("g", "nowhere"), ("h", "g"), ("x", "x"), ("o", " ")], order={"a": 1, "b": 5})
    got = {r["root_id"]: tuple(r)[2:] for r in hierarchy.hierarchy_faults(df).collect()}
    assert got == {"b": ("order", "primary", 2), "c": ("cycle", "c", 0), "d": ("cycle", "c", 0), "e": ("below_cycle", "c", 1), "f": ("below_cycle", "c", 2), "g": ("detached", "g", 0), "h": ("detached", "g", 1), "x": ("cycle", "x", 0), "o": ("detached", "o", 0)}


def test_older_rows_and_repeats_do_not_count(spark):
    new = spark.createDataFrame([("s", "a", "primary", 1, datetime(2025, 1, 1), 1, 0.5, 9, "x", "x")], KIND)
    df = roots(spark, [("primary", None), ("a", "gone")]).union(new).union(new)
    assert hierarchy.hierarchy_faults(df).count() == 0


def random_links(rng, n):
    ids = [f"r{i}" for i in range(n)]
    out = [("primary", None)] + [(r, rng.choice(["primary", *ids[: max(1, i)]])) for i, r in enumerate(ids)]
    for _ in range(n // 20):  # circles and loose ends
        i = rng.randrange(1, n)
        out[i] = (out[i][0], rng.choice([*ids, None, "nobody"]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_agree(spark, seed):
    rng = random.Random(seed)
    df = roots(spark, random_links(rng, 150)).union(roots(spark, [(f"c{i}", f"c{i + 1}") for i in range(70)], "chain")).union(roots(spark, [("p", None)] + [(f"k{i}", "p") for i in range(100)], "star"))
    a = {(r["sample_id"], r["root_id"]): r for r in hierarchy.hierarchies(df, True).collect()}
    b = {(r["sample_id"], r["root_id"]): r for r in hierarchy.hierarchies(df, True, limit=0).collect()}
    c = {(r["sample_id"], r["root_id"]): r for r in hierarchy.hierarchies(df, True, limit=100).collect()}
    for field in ("kind", "top_root_id", "depth", "entry", "exit", "descendants", "path", "parent_root_id", "root_order"):
        assert {k: r[field] for k, r in a.items()} == {k: r[field] for k, r in b.items()} == {k: r[field] for k, r in c.items()}
    for x in (a, b):  # the intervals hold exactly the descendants
        for (s, r), v in x.items():
            if s == "s" and v["kind"] == "tree":
                inner = {k for (s2, k), w in x.items() if s2 == s and w["kind"] == "tree" and w["top_root_id"] == v["top_root_id"] and v["entry"] < w["entry"] < v["exit"]}
                assert inner == {k for (s2, k), w in x.items() if s2 == s and k != r and r in w["path"]} and len(inner) == v["descendants"]


def test_deep_chain(spark):
    df = roots(spark, [("r0", None)] + [(f"r{i}", f"r{i - 1}") for i in range(1, 3000)])
    assert hierarchy.hierarchies(df).agg({"depth": "max"}).first()[0] == 2999


def test_empty_and_null(spark):
    none = spark.createDataFrame([(None,) * 10], KIND)
    for limit in (0, 100):
        assert hierarchy.hierarchies(none, True, limit).count() == 0 and hierarchy.hierarchies(none.limit(0), True, limit).count() == 0


def test_tree_operators(spark):
    df = roots(spark, [("primary", None), ("a", "primary"), ("b", "a"), ("c", "b"), ("d", "primary"), ("x", "y"), ("y", "x")], order={"primary": 0, "a": 1, "b": 2, "c": 3, "d": 2})
    assert {r["root_id"]: r["tree_order"] for r in tree.orders(df).collect()} == {"primary": 0, "a": 1, "b": 2, "c": 3, "d": 1, "x": None, "y": None}
    assert {tuple(r)[1:] for r in tree.closure(df).filter("root_id = 'c'").collect()} == {("primary", "c", 3), ("a", "c", 2), ("b", "c", 1), ("c", "c", 0)}
    off = spark.createDataFrame([("s", "a")], "sample_id string, root_id string")
    assert {r["root_id"] for r in tree.prune(df, off).collect()} == {"primary", "d"}
    breaches = {(r["root_id"], r["breach"]) for r in tree.violations(df).collect()}
    assert {("d", "order"), ("x", "cycle"), ("y", "cycle")} <= breaches
    assert {r["root_id"]: r["stable_id"] for r in tree.stable_ids(df).collect()} == {"primary": "primary", "a": "root-o1-001", "d": "root-o1-002", "b": "root-o2-001", "c": "root-o3-001"}
    assert [tuple(r) for r in tree.repair_cycles(df).collect()] == [("s", "x", "y", "primary")]


def test_corrections(spark):
    df = spark.createDataFrame([("s", r, p, 0.9, ["f"], f"h{r}") for r, p in (("a", "p"), ("b", "a"), ("c", "a"), ("d", "a"))], "sample_id string, root_id string, parent_id string, confidence double, qc_flags array<string>, fingerprint string")
    c = spark.createDataFrame([("s", "a", "q", True, "ha"), ("s", "b", "q", True, "old"), ("s", "c", "q", False, "hc"), ("s", "z", "q", True, "hz"), ("s", "d", "q", True, "hd"), ("s", "d", "r", True, "hd")], "sample_id string, root_id string, parent_id string, valid boolean, fingerprint string")
    out, refused = tree.apply_corrections(df, c)
    assert {(r["root_id"], r["parent_id"], r["confidence"]) for r in out.collect()} == {("a", "q", 0.0), ("b", "a", 0.9), ("d", "a", 0.9)}
    assert {(r["root_id"], r["reason"]) for r in refused.collect()} == {("b", "stale"), ("z", "unknown"), ("d", "repeated")}
