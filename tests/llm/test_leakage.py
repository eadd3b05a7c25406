import random

import pytest

from arborline.llm import leakage as k
from arborline.llm.text import words

RNG = random.Random(5)
POOL = [f"{a}{b}{c}" for a in ("bo", "ka", "ri", "tu", "me", "sal") for b in ("lim", "no", "ver", "da") for c in ("t", "sk", "ra", "pe", "ul")]


def text(n, rng=RNG):
    return " ".join(rng.choice(POOL) for _ in range(n))


ITEMS = [(i, text(60), text(60)) for i in range(1, 31)]


def item_words(i):
    return words(ITEMS[i - 1][1] + " " + ITEMS[i - 1][2])


def altered(ws, every, rng):
    out = []
    for j, w in enumerate(ws):
        if j % every == every - 1:
            out += rng.choice([["changed"], [], [w, "added"]])
        else:
            out.append(w)
    return out


def brute(doc, item):
    """Whether any span of the item aligns with any stretch of the document: dynamic programming over all stretches."""
    import numpy as np

    v = {w: n for n, w in enumerate({*doc, *item})}
    a, b = np.array([v[w] for w in item], int), np.array([v[w] for w in doc], int)
    return any(k.holds_run(k.runs_of(a, b[p : p + 60])) for p in range(0, len(b), 6))


def cases():
    rng = random.Random(7)
    docs, want = [], set()
    for n in range(240):
        i = rng.randrange(1, 31)
        w = item_words(i)
        kind = n % 6
        a = rng.randrange(0, len(w) - 45)
        if kind == 0:
            body, hit = w[a : a + 24], True
        elif kind == 1:
            body, hit = altered(w[a : a + 42], 8, rng), True
        elif kind == 2:
            body, hit = w[a : a + 15], False
        elif kind == 3:
            body, hit = w[a : a + 14] + text(30, rng).split() + w[a + 20 : a + 34], False
        elif kind == 4:
            body, hit = altered(w[a : a + 45], 3, rng), False
        else:
            body, hit = w[a : a + 22] + text(20, rng).split() + item_words(i % 30 + 1)[:21], True
            want.add((n, i % 30 + 1))
        docs.append((n, f"{text(rng.randrange(0, 60), rng)} {' '.join(body)} {text(rng.randrange(0, 60), rng)}"))
        if hit:
            want.add((n, i))
    return docs, want


def test_recall_and_precision(spark):
    docs, want = cases()
    d = spark.createDataFrame([(n, t, "clash") for n, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, question string, answer string")
    got = {tuple(r) for r in k.leaked_items(d, items).collect()}
    assert len(got & want) / len(want) >= 0.99 and len(got - want) <= 0.02 * len(want)
    assert {tuple(r) for r in k.leaked_items(d, items, block_words=1000).collect()} == got  # in four blocks


def test_layout_and_characters(spark):
    w = item_words(3)[10:40]
    s = " ".join(w)
    forms = [s.upper(), "\n".join(w), " ".join(f"**{x}**" for x in w), "<p>" + "</b> <i>".join(w), s.replace("a", "а").replace("e", "е"), s.replace("i", "ｉ"), "​".join(s), ", ".join(w), s.replace(" ", "  \t"), " ".join(f"{x[:3]}-\n{x[3:]}" if j % 9 == 0 else x for j, x in enumerate(w))]
    d = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, question string, answer string")
    assert {tuple(r) for r in k.leaked_items(d, items).collect()} == {(n, 3) for n in range(len(forms))}


def test_agrees_with_alignment_of_everything():
    docs, _ = cases()
    ix = k.build_index([(i, q + " " + a) for i, q, a in ITEMS])
    got = set(k.search_batch(ix, [n for n, _ in docs[:60]], [k.words(t) for _, t in docs[:60]]))
    want = {(n, i) for n, t in docs[:60] for i in range(1, 31) if brute(words(t), item_words(i))}
    assert len(got & want) >= 0.95 * len(want) and not got - want


def test_edges(spark):
    s = " ".join(item_words(1))
    d = spark.createDataFrame([(1, None), (2, ""), (3, text(50_000) + " " + s), (4, s), (4, s), (None, s), (5, "short")], "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS[:2], (50, None, None), (51, "only", None), (None, "x", "y"), ITEMS[0]], "item_id long, question string, answer string")
    assert {tuple(r) for r in k.leaked_items(d, items).collect()} == {(3, 1), (4, 1)}
    assert k.leaked_items(d.limit(0), items).count() == 0 and k.leaked_items(d, items.limit(0)).count() == 0


@pytest.mark.parametrize("matches,found", [([(i, i) for i in range(20)], True), ([(i, i) for i in range(19)], False), ([(i, i + (i > 9)) for i in range(20)], True), ([(i, i) for i in range(40) if i % 3], False), ([], False)])
def test_runs(matches, found):
    assert k.holds_run(matches) is found


def spans(item, doc, run, altered):
    """Whether any span of the item, from match to match, is within its edits of any stretch of the document: edit distances from every start."""
    for i0 in range(len(item) - run + 1):
        for j0 in (j for j, w in enumerate(doc) if w == item[i0]):
            row = list(range(len(doc) - j0 + 1))
            for n, a in enumerate(item[i0:], 1):
                old, row = row, [n]
                for j, b in enumerate(doc[j0:], 1):
                    row.append(min(old[j - 1] + (a != b), old[j] + 1, row[-1] + 1))
                    if a == b and n >= run and row[-1] <= altered * n + 1e-9:
                        return True
    return False


def test_any_alignment():
    import numpy as np

    rng, seen = random.Random(3), [0, 0]
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(16)]
        doc = altered(item[2:13], 4, rng) if rng.random() < 0.7 else [rng.randrange(6) for _ in range(12)]
        doc = [rng.randrange(6) for _ in range(3)] + [-1 if isinstance(w, str) else w for w in doc] + [rng.randrange(6) for _ in range(3)]
        want = spans(item, doc, 7, 1 / 7)
        seen[want] += 1
        assert k.aligned_run(np.array(item), np.array(doc), run=7) is want
    assert min(seen) > 30


@pytest.mark.parametrize("run,edits", [(20, 0), (20, 1), (20, 2), (21, 0), (21, 1), (21, 2), (21, 3)])
def test_least_runs_among_common_words(run, edits):
    rng = random.Random(100 * run + edits)
    common = ["the", "of", "a", "in", "is"]
    mixed = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(POOL) for _ in range(n)]
    items = [(i, mixed(120)) for i in range(20)]
    docs = []
    for n in range(100):
        a = rng.randrange(0, 120 - run)
        body = items[n % 20][1][a : a + run]
        for p in sorted(rng.sample(range(1, run - 1), edits), reverse=True):
            body[p : p + 1] = rng.choice([["changed"], [], [body[p], "added"]])
        docs.append(mixed(80) + body + mixed(80))
    got = set(k.search_batch(k.build_index([(i, " ".join(w)) for i, w in items]), list(range(100)), docs))
    assert sum((n, n % 20) in got for n in range(100)) >= 99


def test_other_figures_make_another_text():
    w = item_words(4)[:60]
    for j in range(3, 60, 8):
        w[j] = f"{j}7"
    ix = k.build_index([(4, " ".join(w))])
    other = [f"{x}1" if x[0].isdigit() and n < 30 else x for n, x in enumerate(w[:30])]  # one figure in eight words: over the share as two edits each
    altered_ = ["changed" if n % 8 == 0 else x for n, x in enumerate(w[:30])]
    got = k.search_batch(ix, [1, 2, 3], [text(20).split() + x + text(20).split() for x in (other, altered_, w[:30])])
    assert set(got) == {(2, 4), (3, 4)}
