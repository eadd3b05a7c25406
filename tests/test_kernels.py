import numpy as np
import pytest

from arborline.operators import kernels as k
from arborline.operators import ownership as own

L = "id long, label int"


def test_shortest_path_on_a_line_and_across_a_gap():
    p = np.array([[0.1 * i, 0, 0] for i in range(20)] + [[5 + 0.1 * i, 0, 0] for i in range(20)], float)
    path = k.path_between(p, 0, 19, 2)
    assert path[0] == 0 and path[-1] == 19 and path == sorted(path)
    assert k.path_between(p, 0, 39, 4)[-1] == 39
    d, _ = k.shortest_paths(k.neighbour_graph(p[:20], 2), [0, 19])
    assert d.max() == pytest.approx(0.9) and d.min() == 0


def test_clusters():
    rng = np.random.default_rng(0)
    p = np.r_[rng.normal(0, 0.05, (40, 3)), rng.normal(3, 0.05, (40, 3)), [[9.0, 9, 9]]]
    c = k.density_clusters(p, 5)
    assert len(set(c[:40])) == 1 and len(set(c[40:80])) == 1 and c[0] != c[40] and c[80] == -1
    assert set(k.density_clusters(p[:6], 5)) == {0}


def test_hulls():
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    assert k.hull_volume(np.r_[cube, [[0.5, 0.5, 0.5]], cube]) == pytest.approx(1)
    assert k.hull_volume(cube[cube[:, 2] == 0]) == 0
    assert k.hull_width(cube[:, :2]) == pytest.approx(2**0.5) and len(k.hull_2d(cube[:, :2])) == 4
    rng = np.random.default_rng(1)
    s = rng.normal(size=(400, 3))
    s /= np.linalg.norm(s, axis=1)[:, None]
    assert 3.8 < k.hull_volume(s) < 4.19


def test_selection_kernels():
    p = np.array([[0.0, 0, 0], [1, 0, 0], [0.01, 0, 0], [0.5, 0, 0]])
    assert k.farthest_points(p, 3) == [0, 1, 3]
    assert k.spread_out(p, np.arange(4), 4, 0.3) == [0, 1, 3]
    assert k.greedy_cover([{1, 2, 3}, {3, 4}, {1, 2}, {9}], np.zeros(4), 0.1) == [0, 3]
    assert k.weighted_quantile(np.array([3.0, 1, 2]), np.array([1.0, 1, 2]), 0.5) == 2
    c, r = k.circle_center(np.array([[1.0, 0], [0, 1], [-1, 0], [0, -1]]) + 2, np.ones(4))
    assert c == pytest.approx([2, 2]) and r == pytest.approx(1)
    assert k.geometric_median(np.array([[0.0, 0], [0, 0], [0, 0], [9, 9]]), np.ones(4)) == pytest.approx([0, 0], abs=1e-3)


def test_growth_follows_a_line():
    p = np.array([[0, 0, -0.1 * i] for i in range(30)], float)
    path = k.grow_path(p, 0, np.array([0, 0, -1.0]), 0.2)
    assert path[0] == 0 and path == sorted(path) and path[-1] >= 27
    assert k.rank_primaries(p, 3)["end"].iloc[0] == 29


def test_coordinate_descent():
    unary = np.array([[0.0, 1], [0.6, 0.5], [0.0, 1]])
    edges = np.array([[0, 1], [1, 2]])
    assert k.descend(unary, edges, np.array([0, 1, 0]), 0.3).tolist() == [0, 0, 0]
    assert k.descend(unary, edges, np.array([0, 1, 0]), 0.0).tolist() == [0, 1, 0]


def test_grouped_kernel(spark):
    import pandas as pd

    df = spark.createDataFrame([(i % 2, float(i)) for i in range(10)], "g int, x double")
    got = k.grouped(df, "g", lambda p: pd.DataFrame({"n": [len(p)], "top": [p["x"].max()]}), "n long, top double")
    assert sorted(map(tuple, got.collect())) == [(0, 5, 8.0), (1, 5, 9.0)]


def test_proposals_and_ledger(spark):
    frozen = spark.createDataFrame([(1, -2), (2, -2), (3, 5)], L)
    out, conflicts = own.merge_proposals(frozen, spark.createDataFrame([(1, 4), (2, 4)], L), spark.createDataFrame([(2, 6)], L))
    assert dict(map(tuple, out.collect())) == {1: 4, 2: -2, 3: 5} and [r["id"] for r in conflicts.collect()] == [2]
    labels = spark.createDataFrame([(1, -2, 7), (2, -2, 7)], "id long, label int, generation int")
    ledger = spark.createDataFrame([(1, 7, [3, 4]), (2, 7, [4])], "id long, generation int, candidates array<int>")
    good = spark.createDataFrame([(1, 1, 4), (1, 2, 4)], "region int, id long, owner int")
    new, breaches = own.commit(labels, ledger, good, 7)
    assert breaches.count() == 0 and {tuple(r) for r in new.collect()} == {(1, 4, 8), (2, 4, 8)}
    bad = spark.createDataFrame([(1, 1, 3), (1, 2, 3)], "region int, id long, owner int")
    same, breaches = own.commit(labels, ledger, bad, 7)
    assert [tuple(r) for r in breaches.collect()] == [(2, "not_a_candidate")] and same is labels
    assert own.commit(labels, ledger, good, 6)[1].first()["breach"] == "stale_generation"


def test_patches_and_splits(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 0, 1, 1, 1, 2, 1, 2, 2])], L)
    t = {r["patch"]: r for r in own.patch_table(edges, labels).collect()}
    assert t[3]["main"] and t[3]["vertices"] == 3 and not t[7]["main"] and t[7]["neighbour"] == 2 and t[7]["share"] == 1.0
    assert {tuple(r) for r in own.island_proposals(edges, labels).collect()} == {(7, 2), (6, 1)}
    after = labels.filter("id <> 4").union(spark.createDataFrame([(4, 0)], L))
    assert {tuple(r) for r in own.splits(edges, labels, after).collect()} == {(0, 1, 2), (1, 2, 3)}


def test_junctions_and_attachments(spark):
    a = spark.createDataFrame([(1, -2, 3, 1, 0.1), (2, -2, 1, 3, 0.1), (3, -2, 3, 1, 5.0), (4, -2, 3, 2, 0.1), (5, 3, 3, 1, 0.1)], "id long, label int, owner int, rival int, arc double")
    r = spark.createDataFrame([(3, 1, 0.5), (2, 0, 0.5)], "label int, parent int, body_start double")
    assert dict(map(tuple, own.resolve_junctions(a, r).collect())) == {1: 1, 2: 1, 3: -2, 4: -2, 5: 3}
    c = spark.createDataFrame([("r", "a", "head", 0.2, 0.5, False), ("r", "b", "tail", 0.3, 0.5, True), ("q", "a", "head", 5.0, 1.0, False)], "root_id string, parent_id string, end string, gap double, separation double, preferred boolean")
    got = {x["root_id"]: x for x in own.best_attachment(c, 1.0).collect()}
    assert got["r"]["parent_id"] == "b" and got["r"]["attached"] and not got["q"]["attached"]


def test_radii(spark):
    d = spark.createDataFrame([("p", 0, 1.0), ("p", 0, 1.0), ("p", 0, 1.0), ("p", 1, 9.0), ("p", 2, 3.0), ("p", 2, 3.0), ("p", 2, 3.0)], "root string, node_id long, distance double")
    assert [r["radius"] for r in own.parent_radii(d, 0.001, ["root"]).orderBy("node_id").collect()] == [2, 2, 2]
    ring = [("p", 0, float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 6, 12)]
    half = [("p", 1, float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 2, 12)]
    s = {r["station"]: r for r in own.station_radii(spark.createDataFrame(ring + half, "root string, station long, u double, v double"), ["root"]).collect()}
    assert s[0]["radius"] == pytest.approx(1) and s[1]["radius"] is None
    profile = spark.createDataFrame([("p", 0.0, 1.0), ("p", 1.0, 1.0), ("p", 3.0, 3.0)], "root string, arc double, radius double")
    assert own.arc_weighted_radius(profile, ["root"]).first()["radius"] == pytest.approx((1 + 2 * 2) / 3)


@pytest.mark.parametrize("shape", ["even", "surface", "clusters", "copies", "line"])
def test_neighbours_against_all_pairs(shape):
    rng = np.random.default_rng(8)
    p = {
        "even": lambda: rng.random((700, 3)), "surface": lambda: np.c_[rng.random((700, 2)), np.zeros(700)], "clusters": lambda: np.r_[rng.normal(0, 1e-3, (400, 3)), rng.normal(5, 1, (300, 3))],
        "copies": lambda: np.repeat(rng.random((30, 3)), 20, axis=0), "line": lambda: np.c_[np.arange(500.0), np.zeros((500, 2))],
    }[shape]()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for n in (1, 6, 40):
        index, distance = k.nearest_neighbours(p, n)
        assert np.array_equal(index, np.argsort(d, axis=1, kind="stable")[:, :n]) and np.allclose(distance, np.sort(d, axis=1)[:, :n])
    assert k.nearest_neighbours(p[:1], 3)[0].shape == (1, 0) and k.nearest_neighbours(p[:3], 9)[0].shape == (3, 2)


def test_many_points_in_little_time():
    import time

    rng = np.random.default_rng(1)
    turn, z = rng.uniform(0, 2 * np.pi, 100_000), rng.uniform(0, 30, 100_000)
    p = np.c_[np.cos(turn), np.sin(turn), z]  # the surface of a tube
    start = time.process_time()
    k.nearest_neighbours(p, 14)
    assert time.process_time() - start < 60


def test_lazy_cover_equals_counting_again():
    rng = np.random.default_rng(6)
    for _ in range(20):
        supports = [set(rng.choice(60, rng.integers(0, 15)).tolist()) for _ in range(30)]
        lengths = rng.random(30) * 0.2
        used, left, want = set(), list(range(30)), []
        while left:
            worth = [(n := len(supports[i] - used)) and n - 1.25 * (len(supports[i]) - n) + 10 * lengths[i] + 0.35 * lengths[i] / 0.1 or -np.inf for i in left]
            j = int(np.argmax(worth))
            if worth[j] <= 0:
                break
            want.append(left.pop(j))
            used |= supports[want[-1]]
        assert k.greedy_cover(supports, lengths, 0.1) == want


def test_orders_are_traced_from_the_axis(spark):
    from arborline.operators import growth
    from arborline.sources.files import synthetic_taproot

    t = synthetic_taproot(spark).toPandas().sort_values("vertex_id")
    p, root = t[["x", "y", "z"]].to_numpy(), t["root"].to_numpy()
    spacing = float(np.median(k.nearest_neighbours(p, 1)[1]))
    traced = growth.trace_orders(p, list(range(180)), spacing, 2)
    first = traced[traced["root_order"] == 1]
    assert 3 <= first["root"].nunique() <= 8 and (first["parent"] == 0).all() and traced["point"].between(0, len(p) - 1).all()
    label = growth.assign_points(p, traced, spacing)
    for branch in (1, 2, 3):  # most of each branch hangs on one traced root and its children
        mine = label[root == branch]
        mine = mine[mine > 0]
        assert len(mine) >= 40
    assert (label[root == 0] == 0).mean() > 0.9
    again = growth.trace_orders(p, list(range(180)), spacing, 2)
    assert again.equals(traced)


def test_tracing_of_nothing():
    from arborline.operators import growth

    none = np.zeros((0, 3))
    assert len(growth.trace_orders(none, [], 0.1)) == 0 and len(growth.assign_points(none, growth.trace_orders(none, [], 0.1), 0.1)) == 0
    line = np.c_[np.zeros((30, 2)), np.arange(30.0)]
    assert growth.trace_orders(line, list(range(30)), 1.0)["root"].nunique() == 1
    assert growth.extend_tip(line, [0, 1], 1.0, np.zeros(30, bool)) == list(range(30))
    assert growth.extend_tip(line, [3], 1.0, np.zeros(30, bool)) == [3]
