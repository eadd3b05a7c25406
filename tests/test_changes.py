import random

import pytest

from arborline.operators import changes

OPS = "session_id string, baseline_fingerprint string, event string, operation_id string, target_operation_id string, sequence long, type string, arguments map<string,string>, root_id string, t long"
MAP = "session_id string, baseline_fingerprint string, numeric_label int, root_id string, parent_id string, link string"


def brute(start, ops):
    """Step by step, as an editor would."""
    tree = {r: p for _, _, n, r, p, _ in start if n is not None and n >= 0}
    first, last = {}, {}
    for o in ops:
        if o[1] != "f":
            continue
        if o[2].strip().lower() == "apply":
            first[o[3]] = min(first.get(o[3], o), o, key=lambda x: x[5])
        else:
            last[o[4]] = max(last.get(o[4], o), o, key=lambda x: x[5])
    touched = {}
    for o in sorted(first.values(), key=lambda x: x[5]):
        if o[3] in last and last[o[3]][2].strip().lower() == "undo":
            continue
        a, r = o[7], o[7].get("root_id")
        if o[6] == "create_root":
            tree[r] = a["parent_id"]
        elif o[6] == "reparent_root":
            tree[r] = a["new_parent_id"]
        elif o[6] in ("delete_root", "merge_roots"):
            x = r if o[6] == "delete_root" else a["source_root_id"]
            to = tree[x] if o[6] == "delete_root" else r
            del tree[x]
            tree = {k: to if p == x else p for k, p in tree.items()}
        touched[r] = o[3]
    return sorted(("s", r, p, touched.get(r, "")) for r, p in tree.items() if r != "primary")


def history(rng, n):
    """A valid log of ``n`` operations on a small tree, with repeats and strays put in."""
    start = [("s", "f", 0, "primary", None, "x")] + [("s", "f", i, f"r{i}", "primary" if i < 4 else f"r{i - 3}", "x") for i in range(1, 9)]
    tree = {r: p for *_, r, p, _ in [(0, 0, *s[3:]) for s in start]}
    tree = {s[3]: s[4] for s in start}
    ops, made = [], 8

    def below(x, top):
        while x is not None:
            if x == top:
                return True
            x = tree.get(x)
        return False

    for q in range(1, n + 1):
        kind = rng.choice(["create_root", "reparent_root", "delete_root", "merge_roots", "redraw_root"])
        alive = [r for r in tree if r != "primary"]
        if len(alive) < 3:
            kind = "create_root"
        r = rng.choice(alive) if alive else None
        if kind == "create_root":
            gone = [f"r{i}" for i in range(1, made + 1) if f"r{i}" not in tree]
            made += 1
            r = rng.choice(gone) if gone and rng.random() < 0.5 else f"r{made}"
            a = {"root_id": r, "parent_id": rng.choice(sorted(tree))}
            tree[r] = a["parent_id"]
        elif kind == "reparent_root":
            a = {"root_id": r, "new_parent_id": rng.choice([x for x in tree if not below(x, r)])}
            tree[r] = a["new_parent_id"]
        elif kind == "delete_root":
            a, p = {"root_id": r}, tree.pop(r)
            tree = {k: p if v == r else v for k, v in tree.items()}
        elif kind == "merge_roots":
            to = rng.choice([x for x in tree if not below(x, r)])
            a = {"root_id": to, "source_root_id": r}
            del tree[r]
            tree = {k: to if v == r else v for k, v in tree.items()}
        else:
            a = {"root_id": r}
        ops.append(("s", "f", rng.choice(["apply", " Apply", "APPLY "]), f"o{q}", None, q, kind, a, "x", 1))
    # Undone operations at the end of the log keep what is in force valid.
    for k, o in enumerate(reversed(ops[-3:])):
        ops.append(("s", "f", "undo", None, o[3], n + 1 + k, None, None, "x", 1))
    ops.append(("s", "f", "redo", None, ops[n - 3][3], n + 9, None, None, "x", 1))
    ops += [(*ops[2][:5], n + 20, *ops[2][6:]), *ops[:5], ("s", "other", "apply", "stray", None, 1, "delete_root", {"root_id": "r1"}, "x", 1)]
    rng.shuffle(ops)
    return start, ops


@pytest.mark.parametrize("seed", range(4))
def test_against_step_by_step(spark, seed):
    start, ops = history(random.Random(seed), 60)
    got = changes.final_links(spark.createDataFrame(ops, OPS), spark.createDataFrame(start + start[:2], MAP))
    assert sorted(map(tuple, got.collect())) == brute(start, ops)


def test_empty_and_null_tables(spark):
    start = [("s", "f", 0, "primary", None, "x"), ("s", "f", 1, "a", "primary", "x"), ("s", "f", -1, "unassigned", None, "x")]
    m, o = spark.createDataFrame(start, MAP), spark.createDataFrame([(None,) * 10], OPS)
    for ops in (o, o.limit(0)):
        assert list(map(tuple, changes.final_links(ops, m).collect())) == [("s", "a", "primary", "")]
    none = spark.createDataFrame([(None,) * 6], MAP)
    assert changes.final_links(o, none).count() == 0 and changes.final_links(o, none.limit(0)).count() == 0


def test_long_chain_of_removals(spark):
    n = 40
    start = [("s", "f", 0, "primary", None, "x")] + [("s", "f", i, f"r{i}", f"r{i - 1}" if i > 1 else "primary", "x") for i in range(1, n + 1)]
    ops = [("s", "f", "apply", f"o{i}", None, i, "delete_root", {"root_id": f"r{i}"}, "x", 1) for i in range(1, n)]
    got = changes.final_links(spark.createDataFrame(ops, OPS), spark.createDataFrame(start, MAP))
    assert list(map(tuple, got.collect())) == [("s", f"r{n}", "primary", "")]
