import random
from types import SimpleNamespace as N

import pytest

from arborline import common


@pytest.mark.parametrize("kind", ["sum", "max", "last"])
def test_running_values_with_a_hot_key(spark, kind):
    rng = random.Random(9)
    rows = [(None if k == 5 else f"k{k}", i, rng.choice([None, rng.randrange(-50, 50)]), "clash") for k in (0, 0, 0, 0, 1, 5) for i in range(k * 1000, k * 1000 + 40)]
    rows = [(k, n, v, c) for n, (k, _, v, c) in enumerate(rows)]
    rng.shuffle(rows)
    got = {r["at"]: r["out"] for r in common.running(spark.createDataFrame(rows, "key string, at long, v long, _own string"), ["key"], ["at"], "v", "out", kind).collect()}
    held: dict = {}
    for k, at, v, _ in sorted(rows, key=lambda r: r[1]):
        old = held.get(k)
        held[k] = old if v is None else v if old is None or kind == "last" else old + v if kind == "sum" else max(old, v)
        assert got[at] == held[k]
    assert len(got) == len(rows)
    assert common.running(spark.createDataFrame([], "key string, at long, v long"), ["key"], ["at"], "v", "out", kind).count() == 0


def test_a_cluster_needs_a_shared_folder():
    none = N(getCheckpointDir=lambda: N(isDefined=lambda: False))
    session = N(sparkContext=N(_jsc=N(sc=lambda: none), master="spark://somewhere:7077"), conf=N(get=lambda name, default: default))
    with pytest.raises(RuntimeError):
        common.checkpoint_dir(session)


def test_checkpoints_are_known_for_removal(spark):
    before = len(common._stored)
    df = common.cut(spark.range(10))
    assert df.count() == 10 and len(common._stored) == before + 1
