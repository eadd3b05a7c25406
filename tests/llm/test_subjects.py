import os

import pytest

from arborline.common import table
from arborline.llm import subjects as s

TERMS = {"sea": ["harbour", "sailor", "anchor", "wave", "tide"], "bread": ["oven", "dough", "baker", "crust", "yeast"], "chess": ["pawn", "knight", "gambit", "bishop", "castle"]}
FILLER = ["Nothing else happened on that day.", "Please see the other page for the rest.", "It was moved to the next week."]


def sentence(subject, i):
    a, b, c = (TERMS[subject][(i + k) % 5] for k in range(3))
    return f"On day {i} the {a} met the {b} near the old {c}."


def examples(spark):
    return spark.createDataFrame([(k * 100 + i, x, sentence(x, i) + " " + sentence(x, i + 1)) for k, x in enumerate(TERMS) for i in range(20)], "example_id long, subject string, text string")


DOCS = "doc_id long, text string, subject string, total long"


def run(spark, texts):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)
    out: dict = {}
    for r in s.document_subjects(d, examples(spark)).collect():
        out.setdefault(r["doc_id"], set()).add(r["subject"])
    return out


def test_a_quarter_of_the_sentences(spark):
    f = FILLER * 4
    texts = [
        " ".join([sentence("sea", 1), *f[:3]]),
        " ".join([sentence("sea", 1), *f[:4]]),
        " ".join([sentence("sea", 1), sentence("bread", 2), *f[:2]]),
        " ".join(f),
        "# Chapter 3\n\n" + sentence("chess", 1).upper() + "\n" + f[0] + "\n\n-- \nsent from the sea harbour",
        "<p>" + sentence("bread", 3) + "</p>",
        "\n".join(sentence("bread", 3).split()),
        None, "", "   ", "Only one anchor.",
        " ".join([sentence("sea", i) for i in range(3000)]),
    ]
    assert run(spark, texts) == {0: {"sea"}, 2: {"sea", "bread"}, 4: {"chess"}, 5: {"bread"}, 6: {"bread"}, 11: {"sea"}}


def test_words_are_learnt_from_the_corpus(spark):
    texts = [f"On day {i} the {TERMS['sea'][i % 5]} met the {TERMS['sea'][(i + 1) % 5]} and the lighthouse and the seagull." for i in range(60)] + ["Then the lighthouse and the seagull went."] + FILLER * 20
    assert run(spark, texts)[60] == {"sea"}


def test_repair_and_sentences():
    assert s.repair("Ã¼ber die MÃ¤rkte") == "über die Märkte" and s.repair("über Ärger") == "über Ärger"
    assert len(s.sentences("A first one. And a second\none here! user7 wrote:\n\nReport 3 / desk 4\nThe third one.")) == 4
    assert s.sentences(None) == []


def test_empty(spark):
    d = spark.createDataFrame([(1, sentence("sea", 1), "x", 1), (None, "x", "x", 1)], DOCS)
    e = examples(spark)
    assert s.document_subjects(d, e.limit(0)).count() == 0 and s.document_subjects(d.limit(0), e).count() == 0
    none = spark.createDataFrame([(None, None, None)], "example_id long, subject string, text string")
    assert s.document_subjects(d, none).count() == 0 and s.document_subjects(d, e.union(none)).count() == 1
    assert s.corpus_subjects(d.limit(0), e).count() == 0
    make_up = {r["subject"]: r for r in s.corpus_subjects(d, e).collect()}
    assert make_up["sea"]["documents"] == 1 and make_up["sea"]["sentence_share"] == 1.0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("the given tables are not there")
    rows = [(r["subject"], r["text"]) for r in table(spark, d, "subject_examples").orderBy("example_id").collect()]
    good = every = 0
    for f in range(5):
        weights, threshold = s.fit([r for k, r in enumerate(rows) if k % 5 != f])
        matcher = s.Matcher(weights, threshold)
        for k, (subject, text) in enumerate(rows):
            if k % 5 == f:
                labels = matcher.label(s.sentences(text))
                every += len(labels)
                good += sum(x == subject for x in labels)
    assert good / every >= 0.97


def test_a_kept_model_labels_alike(spark, tmp_path):
    d = spark.createDataFrame([(i, sentence("sea", i) + " " + FILLER[i % 3], "x", 1) for i in range(20)], DOCS)
    model = s.trained(d, examples(spark))
    s.save_model(spark, model, str(tmp_path / "model"))
    kept = s.load_model(spark, str(tmp_path / "model"))
    assert kept.weights == model.weights and kept.threshold == model.threshold
    assert sorted(s.document_subjects(d, model=kept).collect()) == sorted(s.document_subjects(d, examples(spark)).collect())
    s.save_model(spark, s.Matcher({}, 0.0), str(tmp_path / "none"))
    assert s.document_subjects(d, model=s.load_model(spark, str(tmp_path / "none"))).count() == 0
