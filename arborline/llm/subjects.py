"""The subject areas of documents, from weighted terms and the share of sentences that deal with each.

Terms and weights come from labelled examples: the logarithm of how much likelier a word is in a subject's sentences than
in others (so common words weigh nothing, rare ones that point to a subject much). A multi-pattern automaton finds all terms
of a document in one pass. A sentence deals with the subject of the greatest sum of weights, if at least two different
terms speak for it and the sum passes a threshold calibrated on held-out examples; a document has every subject with which
at least a quarter of its sentences deal. Words that the examples lack are learnt from sentences of the whole corpus whose
subject is known from other words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborline.llm.text import fold, plain

#: Share of sentences from which on a subject is assigned.
SHARE = 0.25

#: Different terms that a sentence must hold.
TERMS = 2

#: Least weight of a term, greatest weight.
LEAST, MOST = 2.3, 6.0

#: A word is learnt from the corpus if it is in at least this share of all sentences: at most words-per-sentence / FLOOR words.
FLOOR = 2e-5

#: Labelled examples that are read at most (a documented bound; the given table has 300).
MAX_EXAMPLES = 100_000

_DOUBLE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")
_END = re.compile(r"(?<=[.?!])[\"'”“)\]]*\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_CLOSED = re.compile(r"[.?!,;][\"'”“)\]]*$")
_LETTERS = re.compile(r"[^\W\d_]{2,}")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte code, where it can be undone."""

    def back(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m[0].encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        return m[0]

    return text if text.isascii() else _DOUBLE.sub(back, text)


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lists of words; headings, sender lines and signatures are no sentences."""
    if not text:
        return []
    out = []
    whole = plain(repair(text))
    if "\r" in whole:
        whole = whole.replace("\r\n", "\n").replace("\r", "\n")
    whole = fold(whole).replace("ae", "a").replace("oe", "o").replace("ue", "u")  # written-out umlauts
    for paragraph in _PARAGRAPH.split(whole):
        lines = paragraph.split("\n")
        for i, line in enumerate(lines):
            if line.strip() == "--" or line.startswith("-- "):
                lines = lines[:i]
                break
        if lines and len(lines[0].split()) <= 6 and not _CLOSED.search(lines[0].strip()) and not _END.search(lines[0].strip()):
            lines = lines[1:]
        for sentence in _END.split(" ".join(lines)):
            w = _LETTERS.findall(sentence)
            if len(w) >= 2:
                out.append(w)
    return out


Weights = dict[str, tuple[str, float]]


def weigh(counts: dict[str, dict[str, int]], totals: dict[str, int], subjects: list[str]) -> Weights:
    """Each word's subject and weight, from the numbers of sentences with the word by label (a label may be no subject)."""
    everything = sum(totals.values())
    out: Weights = {}
    for word, by in counts.items():
        best = max(subjects, key=lambda s: (by.get(s, 0) / max(1, totals.get(s, 0)), s))
        own = (by.get(best, 0) + 0.02) / (totals.get(best, 0) + 1)
        rest = (sum(by.values()) - by.get(best, 0) + 0.5) / (everything - totals.get(best, 0) + 1)
        weight = math.log(own / rest)
        if weight > LEAST:
            out[word] = (best, min(weight, MOST))
    return out


def _example_weights(examples: list[tuple[str, list[list[str]]]], subjects: list[str]) -> Weights:
    counts: dict[str, Counter] = defaultdict(Counter)
    totals: Counter = Counter()
    for subject, own in examples:
        for w in own:
            totals[subject] += 1
            for x in set(w):
                counts[x][subject] += 1
    return weigh(counts, totals, subjects)


class Matcher:
    """The automaton over all terms; labels the sentences of a document."""

    def __init__(self, weights: Weights, threshold: float) -> None:
        self.weights, self.threshold = weights, threshold
        self.subjects = sorted({s for s, _ in weights.values()})
        number = {s: i for i, s in enumerate(self.subjects)}
        self.automaton = ahocorasick.Automaton()
        for k, (word, (subject, weight)) in enumerate(sorted(weights.items())):
            self.automaton.add_word(f" {word} ", (k, number[subject], weight))
        if weights:
            self.automaton.make_automaton()

    def __reduce__(self) -> tuple:
        return Matcher, (self.weights, self.threshold)

    def label(self, parts: list[list[str]]) -> list[str | None]:
        """The subject of each sentence, None for none."""
        out: list[str | None] = [None] * len(parts)
        if not parts or not self.weights:
            return out
        texts = [f" {' '.join(w)} " for w in parts]
        at, bound = 0, len(texts[0])
        found: list[dict[int, tuple[int, float]]] = [{} for _ in parts]  # term: subject, weight; each term counts once
        for end, (k, s, weight) in self.automaton.iter("".join(texts)):
            while end >= bound:
                at += 1
                bound += len(texts[at])
            found[at][k] = (s, weight)
        for i, own in enumerate(found):
            if len(own) >= TERMS:
                score: dict[int, list] = {}
                for s, weight in own.values():
                    held = score.setdefault(s, [0.0, 0])
                    held[0] += weight
                    held[1] += 1
                s, (total, terms) = min(score.items(), key=lambda x: (-x[1][0], x[0]))
                if terms >= TERMS and total >= self.threshold:
                    out[i] = self.subjects[s]
        return out


def threshold_of(scores: list[float]) -> float:
    """Half the score that all but one in a hundred of labelled sentences reach, and what the least terms weigh at least."""
    return max(TERMS * LEAST, 0.5 * float(np.quantile(scores, 0.01))) if scores else TERMS * LEAST


def fit(examples: list[tuple[str, str]]) -> tuple[Weights, float]:
    """Weights from all examples, and the threshold from the held-out scores of five folds."""
    rows = [(s, sentences(t)) for s, t in examples if s is not None and t]
    subjects = sorted({s for s, _ in rows})
    if not subjects:
        return {}, 0.0
    held = []
    for f in range(5):
        part = _example_weights([r for k, r in enumerate(rows) if k % 5 != f], subjects)
        for k, (s, own) in enumerate(rows):
            if k % 5 == f:
                for w in own:
                    found = [part[x] for x in set(w) if x in part]
                    total = sum(v for t, v in found if t == s)
                    if sum(t == s for t, _ in found) >= TERMS:
                        held.append(total)
    return _example_weights(rows, subjects), threshold_of(held)


def corpus_counts(documents: DataFrame, matcher: Matcher) -> DataFrame:
    """Numbers of sentences by word and label over the whole corpus (word '' counts the sentences; label '' is none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(w, s, n) for s, by in counts.items() for w, n in by.items()], columns=["word", "label", "n"])

        for batch in batches:
            for text in batch["text"]:
                parts = sentences(text)
                for w, label in zip(parts, matcher.label(parts)):
                    own = counts[label or ""]
                    own[""] += 1
                    own.update(set(w))
            if sum(map(len, counts.values())) > 500_000:
                yield rows()
                counts.clear()
        yield rows()

    part = documents.select("text").filter("text is not null").mapInPandas(run, "word string, label string, n long")
    return part.groupBy("word", "label").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame, matcher: Matcher, subjects: list[str]) -> Weights:
    """Weights of all words that are in at least FLOOR of the corpus' sentences, given the labels of a first pass."""
    from arborline.common import stored

    counts = stored(corpus_counts(documents, matcher))
    totals = {r["label"]: r["n"] for r in counts.filter("word = ''").collect()}
    least = max(10.0, FLOOR * sum(totals.values()))
    common = counts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= least)
    rows = counts.join(common, "word").groupBy("word").agg(F.collect_list(F.struct("label", "n")).alias("by")).collect()
    return weigh({r["word"]: {x["label"]: x["n"] for x in r["by"]} for r in rows}, totals, subjects)


def sentence_labels(documents: DataFrame, matcher: Matcher) -> DataFrame:
    """``doc_id, subject, sentences, total`` for each document and each subject of any of its sentences (null: none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                parts = sentences(text)
                by = Counter(matcher.label(parts))
                rows += [(doc, s, n, len(parts)) for s, n in by.items()] or [(doc, None, 0, 0)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "sentences", "total"])

    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, subject string, sentences long, total long")


def trained(documents: DataFrame, examples: DataFrame) -> Matcher:
    """A matcher with terms of the examples and of the corpus."""
    rows = examples.filter("subject is not null and text is not null").orderBy("example_id").limit(MAX_EXAMPLES).collect()
    weights, threshold = fit([(r["subject"], r["text"]) for r in rows])
    if not weights:
        return Matcher(weights, threshold)
    weights = weights | learn(documents, Matcher(weights, threshold), sorted({s for s, _ in weights.values()}))
    found = [(r["subject"], [weights[x] for x in set(w) if x in weights]) for r in rows for w in sentences(r["text"])]
    scores = [sum(v for t, v in own if t == s) for s, own in found if sum(t == s for t, _ in own) >= TERMS]
    return Matcher(weights, threshold_of(scores))


def save_model(spark: SparkSession, matcher: Matcher, path: str) -> None:
    """Writes a trained matcher as a table of terms, so that later documents are labelled as earlier ones were."""
    rows = [(w, s, float(x), float(matcher.threshold)) for w, (s, x) in sorted(matcher.weights.items())]
    spark.createDataFrame(rows or [(None, None, None, float(matcher.threshold))], "term string, subject string, weight double, threshold double").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Matcher:
    """The matcher of ``save_model``; its terms (bounded by the examples' words and by 1 / FLOOR) are collected."""
    rows = spark.read.parquet(path).collect()
    return Matcher({r["term"]: (r["subject"], r["weight"]) for r in rows if r["term"] is not None}, rows[0]["threshold"] if rows else 0.0)


def document_subjects(documents: DataFrame, examples: DataFrame | None = None, model: Matcher | None = None) -> DataFrame:
    """``doc_id, subject``: each subject with which a quarter or more of a document's sentences deal.

    ``documents``: doc_id, text; ``examples``: example_id, subject, text. Null and empty texts and texts without
    sentences have no subject, and without examples no document has one. With a ``model`` (``trained``, ``load_model``) the
    examples are not read and nothing is learnt from these documents, so that a document keeps its subjects as the corpus grows. Sentences of two subjects in a tie go to the
    alphabetically first. Equal documents get equal subjects.
    """
    labels = sentence_labels(documents, model or trained(documents, examples))
    return labels.filter("subject is not null and sentences >= total * cast(" + str(SHARE) + " as double)").select("doc_id", "subject")


def corpus_subjects(documents: DataFrame, examples: DataFrame | None = None, model: Matcher | None = None) -> DataFrame:
    """The make-up of the corpus: per subject (null: none) its documents, sentences, and their shares of all."""
    labels = sentence_labels(documents, model or trained(documents, examples))
    has = F.col("subject").isNotNull() & (F.col("sentences") >= F.col("total") * SHARE)
    by = labels.groupBy("subject").agg(F.sum("sentences").alias("sentences"), F.count(F.when(has, 1)).alias("documents"))
    every = by.agg(F.sum("sentences").alias("every"))
    share = F.try_divide(F.col("sentences").cast("double"), F.col("every").cast("double"))
    return by.crossJoin(F.broadcast(every)).select("subject", "documents", "sentences", share.alias("sentence_share"))
