import json
from datetime import datetime, timedelta

from arborline.operators import drift

KIND = "file_id long, station_id string, session_id string, sample_id string, written_at timestamp, received_at timestamp, body string, change string, k long"


def files(spark, bodies, station="s", first=1):
    t = datetime(2024, 1, 1)
    rows = [(first + i, station, f"x{i}", "a", t + timedelta(days=i), t + timedelta(days=i, hours=1), b if isinstance(b, (str, type(None))) else json.dumps(b), "clash", 1) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, KIND)


def found(df, blocks=None):
    return sorted(map(tuple, drift.schema_changes(df, blocks).collect()))


def test_each_kind_of_change(spark):
    df = files(spark, [
        {"schema": "v1", "t": {"window": 1, "gravity": [0]}, "n": 5},
        {"$schema": "v1", "t": {"window": "1", "gravity": [1]}, "n": 5},
        {"$schema": "v2", "t": {"window": "2", "gravity": [1], "new": True}},
        {"$schema": "v2", "t": "gone"},
    ])
    assert found(df) == [(2, "renamed", "schema", "$schema"), (2, "retyped", "t.window", ""), (3, "added", "t.new", ""), (3, "removed", "n", ""), (4, "retyped", "t", "")]


def test_null_keeps_the_type_last_seen(spark):
    assert found(files(spark, [{"a": 1}, {"a": None}, {"a": 2.5}, {"a": None}, {"a": "x"}])) == [(5, "retyped", "a", "")]
    assert found(files(spark, [{"a": None}, {"a": 1}])) == []
    assert found(files(spark, [{"o": {"a": 1}}, {"o": None}, {"o": {"b": []}}])) == []


def test_rename_needs_type_and_name_or_value(spark):
    assert found(files(spark, [{"alpha": 7}, {"omega": 7}])) == [(2, "renamed", "alpha", "omega")]
    assert found(files(spark, [{"alpha": 7}, {"omega": 8}])) == [(2, "added", "omega", ""), (2, "removed", "alpha", "")]
    assert found(files(spark, [{"tip_window": 7}, {"tip_window_mm": "7"}])) == [(2, "added", "tip_window_mm", ""), (2, "removed", "tip_window", "")]


def test_unreadable_repeated_and_late_files(spark):
    good = files(spark, ["﻿" + json.dumps({"a": 1}), '{"a": 1, "b', None, "[1]", "", {"a": "x"}])
    assert found(good.union(good)) == [(6, "retyped", "a", "")]


def test_blocks_give_the_same(spark):
    bodies = [{"a": None if i % 3 else i, "b" if i % 4 else "c_b": "x" if i % 5 else 1, "o": {"k": i} if i % 2 else {"k": str(i), "l": 1}} for i in range(40)]
    df = files(spark, bodies).union(files(spark, bodies[::-1], "t", 100)).union(files(spark, [{"z": 1}], "u", 200))
    assert found(df, 1) == found(df, 7) == found(df, 30)


def test_empty_and_null_tables(spark):
    none = spark.createDataFrame([(None,) * 9], KIND)
    assert found(none) == [] and found(none.limit(0)) == []
    assert drift.stable_table(none, {"a": ["a"]}).count() == 0 and drift.union_schema(none).count() == 0


def test_stable_table_and_union_schema(spark):
    df = files(spark, [{"schema": "v1", "w": 0.5, "x": 1}, {"$schema": 2, "w": [0.5]}, {"schema": None, "w": {"value": 0.5, "unit": "mm"}}, {"w": "0,5 mm"}])
    rows = {r["file_id"]: r for r in drift.stable_table(df, {"schema": ["schema", "$schema"], "w": ["w"]}).collect()}
    assert [rows[i]["w_number"] for i in (1, 2, 3, 4)] == [0.5] * 4
    assert [rows[i]["w"]["kind"] for i in (1, 2, 3, 4)] == ["number", "array", "object", "string"]
    assert rows[2]["schema"]["number"] == 2.0 and rows[2]["schema"]["name"] == "$schema" and rows[3]["schema"]["kind"] is None
    assert rows[1]["rest"] == {"x": "1"}
    u = {(r["path"], r["kind"]): r for r in drift.union_schema(df).collect()}
    assert u["w", "array"]["alternatives"] == 4 and u["w.unit", "string"]["files"] == 1 and u["schema", None]["files"] == 1


def test_strange_bodies(spark):
    deep = '{"a":' * 1000 + "1" + "}" * 1000
    df = files(spark, ['{"k\\ud800": "x\\udfff", "n": 1}', deep, '{"n": "1", "big": 1e999, "int": 123456789012345678901234567890}', '{"n": NaN}'])
    assert [x[:3] for x in found(df)] == [(2, "added", "a"), (2, "removed", "k?"), (2, "removed", "n"), (3, "added", "big"), (3, "added", "int"), (3, "added", "n"), (3, "removed", "a"), (4, "removed", "big"), (4, "removed", "int"), (4, "retyped", "n")]
    assert drift.stable_table(df, {"n": ["n"]}).count() == 4 and drift.union_schema(df).count() > 1000


def test_any_depth(spark):
    nest = lambda n, x: '{"a":' * n + x + "}" * n
    n = 1200
    path = ".".join(["a"] * n)
    assert found(files(spark, [nest(n, "1"), nest(n, '"x"'), nest(n, "[" * 4000 + "]" * 4000)])) == [(2, "retyped", path, ""), (3, "retyped", path, "")]
    deep = nest(20_000, '{"k\\u00e4":[true, null, -1.5e3, NaN, {}], "s":"\\"x"}')
    assert drift.canonical(drift.parse_deep(deep)) == deep.replace('":', '": ').replace("-1.5e3", "-1500")
    assert drift.read_object(deep[:-1]) is None
    for bad in ('{"a" 1}', '{"a": 1,}', "[1 2]", "{} {}", '{"a": ]}', "", "[,]", '{1: 2}'):
        try:
            drift.parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_columns_come_from_the_union_and_its_renamings(spark):
    df = files(spark, [
        {"schema": "v1", "t": {"window": 1, "gravity": [0, 1]}, "flag": "on", "m": {"n": 5}},
        {"$schema": "v1", "t": {"window_mm": 1, "gravity": {"x": 0}}, "flag": True, "m": {"n": 6}},
        {"$schema": "v2", "t": {"window_mm": [2.5], "gravity": {"x": 0}}, "flag": 0},
    ])
    fields = drift.inferred_fields(drift.readable_files(df))
    assert fields == {"schema": ["$schema", "schema"], "flag": ["flag"], "m_n": ["m.n"], "t_gravity": ["t.gravity"], "t_window_mm": ["t.window_mm", "t.window"]}
    rows = sorted(drift.stable_table(df).collect(), key=lambda r: r["file_id"])
    assert [r["schema_text"] for r in rows] == ["v1", "v1", "v2"] and [r["t_window_mm_number"] for r in rows] == [1.0, 1.0, 2.5]
    assert [r["flag_boolean"] for r in rows] == [True, True, False] and [r["t_gravity"]["kind"] for r in rows] == ["array", "object", "object"]
    assert all(r["rest"] == {} for r in rows)


def test_names_in_one_file_are_never_one_column(spark):
    df = files(spark, [{"rate": 1}, {"rate_x": 1}, {"rate": 1, "rate_x": 1}])
    assert found(df)[0] == (2, "renamed", "rate", "rate_x")
    assert sorted(drift.inferred_fields(drift.readable_files(df)).values()) == [["rate"], ["rate_x"]]


def test_unions_fuse_in_any_grouping():
    import random

    rng = random.Random(3)
    value = lambda d: rng.choice([1, "x", True, None, [1]] + ([{k: value(d - 1) for k in rng.sample("abcd", 2)}] * 3 if d else []))
    docs = [{k: value(2) for k in rng.sample("abcde", 3)} for _ in range(60)]
    one = drift.Union()
    whole = [one.fuse(x) for x in docs]
    for size in (1, 7, 20):
        state, got = None, []
        for k in range(0, len(docs), size):
            own, seen = drift.Union(), drift.Union.unpack(state)
            got += [seen.fuse(x) for x in docs[k : k + size]]
            for x in docs[k : k + size]:
                own.fuse(x)
            state = own.pack() if state is None else drift.Union.unpack(state).then(drift.Union.unpack(own.pack())).pack()
        assert [sorted(x) for x in got] == [sorted(x) for x in whole]
    alone = [len([e for e in drift.Union().fuse(x) if e]) for x in docs]
    assert not any(alone) and any(e[0] == "retyped" for x in whole for e in x)
