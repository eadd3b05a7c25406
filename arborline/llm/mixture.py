"""Mixing sources to target shares of all tokens by Poisson replication.

Each document is repeated a number of times drawn from a Poisson distribution cut at the source's greatest number of
repeats; the mean of the cut distribution is the source's repetition rate, so a source of rate 0.3 keeps three documents
in ten and one of rate 2.4 repeats each some 2.4 times. The draw inverts the distribution at a hash of seed and document,
so it needs no state and comes out the same wherever and whenever it runs.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborline.common import partitions, stored

#: The vocabulary of the tokens that are counted.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits a text before byte-pair encoding with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts are encoded in pieces of at least so many characters.
PIECE = 100_000

# A blank after another character: no match of PATTERN goes over this place or looks across it from before, so that a text
# may be cut here. (What Python's \S matches is no blank to the tokenizer either.)
_BREAK = re.compile(r"(?<=\S)[ \n]")

SEED = 20240229


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that have together as many tokens as the whole."""
    at = 0
    while m := _BREAK.search(text, at + PIECE):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of each document; a null text has none. Texts are encoded piece by piece, with the count of the whole."""

    def tokens(text: str | None) -> int:
        if not text:
            return 0
        encode = _encoding(vocabulary).encode_ordinary
        return sum(len(encode(piece)) for piece in pieces(text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [tokens(t) for t in batch["text"]]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").mapInPandas(run, "doc_id long, source string, n_tokens long")


def source_key(source: Column) -> Column:
    """A source's name without case and outer blanks, inner blanks as underscores; blank is null."""
    key = F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s_]+|[\s_]+$", "")), r"[\s_]+", "_")
    return F.when(F.length(key) > 0, key)


def cut_poisson(rate: float, cap: int) -> list[float]:
    """The distribution function at 0 .. cap-1 of a Poisson variable cut at ``cap`` whose mean after the cut is ``rate``."""
    if cap <= 0 or rate <= 0:
        return [1.0] * min(1, cap)
    if rate >= cap:
        return [0.0] * cap

    def table(mean: float) -> list[float]:
        p, total, out = math.exp(-mean), 0.0, []
        for k in range(cap):
            total += p
            out.append(min(1.0, total))
            p *= mean / (k + 1)
            if p < 1e-18 and k > mean:
                break
        return out

    def mean_after_cut(mean: float) -> float:
        return sum(1 - c for c in table(mean))

    low, high = 0.0, 700.0 if cap > 100 else 60.0 + 4 * cap
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if mean_after_cut(middle) < rate else (low, middle)
    return table(low)


def plan(available: dict[str, int], targets: list[tuple[str, float, float]], total_tokens: float | None = None) -> list[dict]:
    """Per source its repetition rate and distribution.

    Targets without tokens cannot be met; the shares of the others keep their proportions. Without a given total the
    mixture is as large as all shares can be reached at the caps; with a greater one, sources at their cap fall short and
    the reached shares show it. ``targets``: (source, share, greatest repeats), repeats rounded down.
    """
    usable = [(s, share, int(math.floor(cap))) for s, share, cap in targets if share > 0 and cap >= 1 and available.get(s, 0) > 0]
    whole = sum(share for _, share, _ in usable)
    if total_tokens is None and usable:
        total_tokens = min(available[s] * cap / (share / whole) for s, share, cap in usable)
    out = []
    for s, share, cap in usable:
        rate = total_tokens * share / whole / available[s]
        rate = float(cap) if rate > cap * (1 - 1e-9) else rate
        out.append({"source": s, "target_share": share, "max_repeats": cap, "available": available[s], "rate": rate, "table": cut_poisson(rate, cap)})
    return out


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / float(1 << 53)


#: Rates tried around a planned rate in one pass over the counts; each pass narrows the bracket by as much.
TRIALS = 32


def calibrate(drawn: DataFrame, rows: list[dict], passes: int = 2) -> list[dict]:
    """Moves each source's rate so that the tokens its own draws give come nearest to rate times available tokens.

    The draws are fixed by the hashes and the tokens they give grow with the rate, so a bracket around the planned rate is
    searched on a grid, all sources and rates in one aggregation per pass. ``drawn``: source, n_tokens, u. Sources at
    their cap are left.
    """
    spark = drawn.sparkSession
    open_ = {r["source"]: (0.4 * r["rate"], min(r["max_repeats"], 2.2 * r["rate"])) for r in rows if r["rate"] < r["max_repeats"]}
    by = {r["source"]: r for r in rows}
    best = {s: (abs(by[s]["rate"]) * by[s]["available"], by[s]["rate"]) for s in open_}
    for _ in range(passes if open_ else 0):
        trial = {s: [a + (b - a) * k / TRIALS for k in range(TRIALS + 1)] for s, (a, b) in open_.items()}
        tables = spark.createDataFrame([(s, [cut_poisson(x, by[s]["max_repeats"]) for x in xs]) for s, xs in trial.items()], "source string, tables array<array<double>>")
        counts = F.transform("tables", lambda t: F.size(F.filter(t, lambda c: c <= F.col("u"))) * F.col("n_tokens"))
        sums = drawn.join(F.broadcast(tables), "source").select("source", F.posexplode(counts).alias("k", "n")).groupBy("source", "k").agg(F.sum("n").alias("n")).collect()
        for r in sums:
            s, x = r["source"], trial[r["source"]][r["k"]]
            best[s] = min(best[s], (abs(r["n"] - by[s]["rate"] * by[s]["available"]), x))
        for s, (a, b) in open_.items():
            w = (b - a) / TRIALS
            open_[s] = (max(a, best[s][1] - w), min(b, best[s][1] + w))
    return [r | {"drawn": best[r["source"]][1], "table": cut_poisson(best[r["source"]][1], r["max_repeats"])} if r["source"] in best else r | {"drawn": r["rate"]} for r in rows]


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report on it.

    The mixture: ``position_key, doc_id, copy, source, n_tokens, text``, a row per copy (1 ..), globally shuffled: range
    partitioned and sorted by a hash of document and copy. The report: ``source, target_share, max_repeats, available_tokens,
    planned_rate, rate`` (the one drawn with), ``documents, copies, tokens, reached_share, share_error`` (reached less target)
    for every source of the targets. ``documents``: doc_id (unique),
    text, source. Source names count alike despite case, outer blanks and blanks for underscores; documents of other
    sources, without a source or without tokens stay out. Of repeated targets of a source the greatest share counts. The
    list of targets (one row per source) is collected, the documents never are. Empty tables give an empty mixture.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    wanted = [tuple(r) for r in t.collect()]
    counted = stored(count_tokens(documents.filter("doc_id is not null").filter(source_key(F.col("source")).isin([s for s, _, _ in wanted])), vocabulary))
    available = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    spark = documents.sparkSession
    counted = counted.filter("n_tokens > 0").withColumn("u", uniform(seed, "doc_id"))
    rows = calibrate(counted.select("source", "n_tokens", "u"), plan(available, wanted, total_tokens))
    rates = spark.createDataFrame([(r["source"], r["table"], r["rate"], r["drawn"]) for r in rows], "source string, below array<double>, planned_rate double, rate double")
    repeats = counted.join(F.broadcast(rates), "source").withColumn("copies", F.size(F.filter("below", lambda c: c <= F.col("u")))).filter("copies > 0")
    chosen = repeats.select("doc_id", "source", "n_tokens", "copies")
    copies = chosen.join(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.xxhash64(F.lit(seed + 1), "doc_id", "copy")
    mixed = copies.select(key.alias("position_key"), "doc_id", "copy", "source", "n_tokens", "text").repartitionByRange(partitions(spark), "position_key").sortWithinPartitions("position_key", "doc_id", "copy")

    per = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    every = per.agg(F.sum("tokens").alias("every"))
    have = spark.createDataFrame(list(available.items()), "source string, available_tokens long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = t.join(F.broadcast(have), "source", "left").join(F.broadcast(rates.select("source", "planned_rate", "rate")), "source", "left").join(per, "source", "left").crossJoin(F.broadcast(every))
    report = report.select("source", "target_share", "max_repeats", zero("available_tokens"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("planned_rate", "rate")), zero("documents"), zero("copies"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("reached_share"))
    report = report.withColumn("share_error", F.col("reached_share") - F.col("target_share"))
    return mixed, report
