"""Passages of held-out test items in a corpus, found through an embedding of edit distance into Hamming distance.

Every window of an item's words is embedded by a CGK random walk (Chakraborty, Goldenberg, Koucky 2016): a pointer walks
over the words and at each step moves on or stays, by a random bit of the step and the word under it; the words under it
are the code. After an edit two walks come together again with good probability, so windows with few edits agree in most
places of their codes. Each of several tables samples a few places of a code as a key (bit sampling); windows of documents
with a key of an item's window are candidates, and their alignment with the item decides exactly.

Test items are held in blocks of bounded size, to which all documents are streamed; nothing of the corpus is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborline.llm.text import words

#: Least number of running words of an item, and the greatest share of them that may be altered.
RUN, ALTERED = 20, 1 / 7

#: Words that a run has in common with the document at least: an altered word costs an edit each.
LEAST_MATCHES = RUN - int(ALTERED * RUN)

#: Words of a window, words between the starts of a document's windows.
WINDOW, STRIDE = 16, 4

#: Random walks, tables of each, and places sampled by a table.
WALKS, TABLES, PLACES = 6, 4, 5

#: Steps of a walk: the pointer moves half a word a step.
STEPS = 2 * WINDOW

#: Words of a candidate window that must stand near the item's diagonal before the alignment is made: a window within a run
#: of RUN words with its three edits has as many.
NEAR = 13

#: Words by which such a word may have moved.
SHIFT = 3

#: Bits of the filter in front of a table (small enough for a processor's cache), documents gone through at a time.
SIEVE, PIECE = 18, 250

#: Greatest number of item words held by a Python worker at a time (some 400 bytes of index a word); more are looked for block by block.
BLOCK_WORDS = 200_000

#: Pairs of windows compared at a time (small enough for a processor's cache).
CACHED = 4096

#: Words of documents that a task takes together through the blocks of items.
HOLD = 1_000_000

_SEED = 20240229


class Index(NamedTuple):
    """The windows of a block of items: words as numbers, and per table the sorted keys with their windows."""

    vocabulary: dict[str, int]
    figure: np.ndarray
    flat: np.ndarray
    offset: np.ndarray
    item: list[int]
    owner: np.ndarray
    bits: np.ndarray
    places: np.ndarray
    factors: np.ndarray
    keys: list[np.ndarray]
    windows: list[np.ndarray]
    sieve: np.ndarray


_DIGIT = re.compile(r"\d")


def has_figure(word: str) -> bool:
    return _DIGIT.search(word) is not None


class _Unknown(dict):
    """Numbers of words outside the vocabulary: 0, or for figures one of their own; each word is looked at once."""

    def __init__(self, figure: int) -> None:
        super().__init__()
        self.figure = figure

    def __missing__(self, word: str) -> int:
        out = self[word] = self.figure if has_figure(word) else 0
        return out


def _codes(flat: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The code of the window at each start: STEPS words, those beyond the window as -1."""
    out = np.empty((STEPS, len(starts)), np.int32)
    at = np.zeros(len(starts), np.int64)
    for j in range(STEPS):
        inside = at < WINDOW
        w = np.where(inside, flat[starts + np.minimum(at, WINDOW - 1)], -1)
        out[j] = w
        at += (bits[w] >> np.uint64(j)).astype(np.int64) & 1
    return out


def _table_keys(codes: np.ndarray, places: np.ndarray, factors: np.ndarray) -> np.ndarray:
    key = np.zeros(codes.shape[1], np.uint64)
    for p, f in zip(places, factors):
        key = (key ^ (codes[p].astype(np.int64) + 2).astype(np.uint64)) * f
        key ^= key >> np.uint64(31)
    return key


def build_index(items: list[tuple[int, str]]) -> Index:
    """The index of a block of items, given as (id, text)."""
    vocabulary: dict[str, int] = {}
    texts = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)] for _, t in items]
    offset = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    flat = np.array([w for t in texts for w in t] + [0] * WINDOW, np.int32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    rng = np.random.default_rng(_SEED)
    size = len(vocabulary) + 3
    # Step and word give a bit; unknown words (0), unknown figures (after the vocabulary) and the end (-1, the last) have bits of their own.
    bits = rng.integers(0, 2**63, (WALKS, size), np.uint64)
    places = np.stack([np.sort(rng.choice(STEPS - 4, PLACES, replace=False)) for _ in range(WALKS * TABLES)])
    factors = rng.integers(0, 2**63, (WALKS * TABLES, PLACES), np.uint64) | np.uint64(1)
    starts = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(offset[:-1], offset[1:]) if b - a >= WINDOW] or [np.zeros(0, np.int64)])
    keys, windows = [], []
    sieve = np.zeros((WALKS * TABLES, 1 << SIEVE), bool)
    for w in range(WALKS):
        codes = _codes(flat, starts, bits[w])
        for t in range(w * TABLES, (w + 1) * TABLES):
            k = _table_keys(codes, places[t], factors[t])
            order = np.argsort(k, kind="stable")
            keys.append(k[order])
            windows.append(starts[order])
            sieve[t, (k >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
    figure = np.array([False, *map(has_figure, vocabulary), True, False])
    return Index(vocabulary, figure, flat, offset, [i for i, _ in items], owner, bits, places, factors, keys, windows, sieve)


def _candidates(ix: Index, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (start in the documents, start in the items) that share a key in some table, each once."""
    docs, items = [], []
    for w in range(WALKS):
        codes = _codes(flat, starts, ix.bits[w])
        for t in range(w * TABLES, (w + 1) * TABLES):
            k = _table_keys(codes, ix.places[t], ix.factors[t])
            maybe = np.flatnonzero(ix.sieve[t, (k >> np.uint64(64 - SIEVE)).astype(np.int64)])
            if not len(maybe):
                continue
            a = np.searchsorted(ix.keys[t], k[maybe], "left")
            n = np.searchsorted(ix.keys[t], k[maybe], "right") - a
            if not n.sum():
                continue
            docs.append(np.repeat(starts[maybe], n))
            first = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n)
            items.append(ix.windows[t][first + np.arange(n.sum())])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.sort(np.concatenate(docs) * len(ix.flat) + np.concatenate(items))
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
    return pair // len(ix.flat), pair % len(ix.flat)


def _near(ix: Index, flat: np.ndarray, d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether at least NEAR words of the item's window stand within three words of their place in the document."""
    padded = np.concatenate([np.zeros(SHIFT, flat.dtype), flat, np.zeros(SHIFT, flat.dtype)])
    out = np.empty(len(d), bool)
    for k in range(0, len(d), CACHED):
        around = padded[d[k : k + CACHED, None] + np.arange(WINDOW + 2 * SHIFT)]
        own = ix.flat[i[k : k + CACHED, None] + np.arange(WINDOW)]
        hit = own == around[:, SHIFT : SHIFT + WINDOW]
        for s in range(2 * SHIFT + 1):
            if s != SHIFT:
                hit |= own == around[:, s : s + WINDOW]
        out[k : k + CACHED] = hit.sum(axis=1, dtype=np.int8) >= NEAR
    return out


def runs_of(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """The matches of a longest common subsequence, as (place in the item, place in the document)."""
    n, m = len(item), len(doc)
    best = np.zeros((n + 1, m + 1), np.int32)
    same = item[:, None] == doc[None, :]
    for i in range(n - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(same[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if same[i, j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def holds_run(matches: list[tuple[int, int]], item_figures: np.ndarray | None = None, doc_figures: np.ndarray | None = None, run: int = RUN, altered: float = ALTERED) -> bool:
    """Whether some span from match to match has ``run`` item words or more with at most that share of edits.

    Edits between two matches are the larger of the words missing on either side, and one more for each figure on one side
    that must stand against a figure on the other.
    """
    gap = (lambda f, a, b: int(f[a:b].sum())) if item_figures is not None else (lambda f, a, b: 0)
    for x in range(len(matches)):
        errors = 0
        i0 = matches[x][0]
        for y in range(x + 1, len(matches)):
            (i, j), (p, q) = matches[y], matches[y - 1]
            errors += max(i - p, j - q) - 1
            if i - p > 1 and j - q > 1:
                errors += min(gap(item_figures, p + 1, i), gap(doc_figures, q + 1, j))
            length = i - i0 + 1
            if length >= run and errors <= altered * length + 1e-9:
                return True
            if errors > altered * (matches[-1][0] - i0 + 1) + 1e-9:
                break
    return False


def aligned_run(item: np.ndarray, doc: np.ndarray, item_figures: np.ndarray | None = None, doc_figures: np.ndarray | None = None, run: int = RUN, altered: float = ALTERED) -> bool:
    """Whether ``holds_run`` is true of any alignment of the two, not only of one with the most matches.

    A word may be altered into another at the cost of one edit, but not a figure into another figure: that is two edits, a
    word left out and one put in, since a text built like the item with other figures is no passage of it.

    Row by row of the item, for each number of edits the most item words that a span may have that began with a match and
    ends at this place: the least edits of every span, over all alignments. A span of twice ``half`` words can be halved,
    and the half with the lesser share of edits still has ``run`` words when edits at its ends are left off, so that more
    edits than fit a shorter span need not be followed.
    """
    half = run
    while half - int(altered * half + 1e-9) < run:
        half += 1
    edits = int(altered * (2 * half - 1) + 1e-9)
    need = np.array([max(run, int(np.ceil(e / altered - 1e-9))) for e in range(edits + 1)])[:, None]
    none = -len(item) - 1
    last = np.full((edits + 1, len(doc) + 1), none, np.int32)
    for x, w in enumerate(item):
        both, now = last[:, :-1] + 1, np.full_like(last, none)
        same = np.flatnonzero(doc == w)
        if len(same):
            ends = both[:, same]
            ends[0] = np.maximum(ends[0], 1)
            if (ends >= need).any():
                return True
            now[:, same + 1] = ends
        other = both[:-1]
        if item_figures is not None and item_figures[x]:
            other = np.where(doc_figures[None, :], none, other)
        now[1:, 1:] = np.maximum(now[1:, 1:], other)
        now[1:] = np.maximum(now[1:], last[:-1] + 1)
        for e in range(1, edits + 1):
            np.maximum(now[e, 1:], now[e - 1, :-1], out=now[e, 1:])
        last = now
    return False


def _dense(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether enough of the item's words stand close enough together for a run.

    Of a run, some RUN running item words have at most the run's share of edits, so at least LEAST_MATCHES of them stand
    in a stretch of RUN and as many more words as may have been put in.
    """
    width = RUN + int(ALTERED * RUN)
    sums = np.r_[0, np.cumsum(np.isin(doc, item))]
    return bool((sums[min(width, len(doc)) :] - sums[: len(sums) - min(width, len(doc))]).max() >= LEAST_MATCHES)


def _confirmed(ix: Index, doc: np.ndarray, item: int, starts: np.ndarray, at: np.ndarray) -> bool:
    """Aligns the item with the stretch of the document around each cluster of candidate windows."""
    own = ix.flat[ix.offset[item] : ix.offset[item + 1]]
    place = at - ix.offset[item]
    order = np.argsort(starts)
    starts, place = starts[order], place[order]
    cut = np.flatnonzero(np.diff(starts) > 2 * len(own)) + 1
    for s, p in zip(np.split(starts, cut), np.split(place, cut)):
        low = max(0, int((s - p).min()) - 8, int(s.min()) - len(own) - 8)
        high = int(max(s.max() + WINDOW, (s - p).max() + len(own))) + 8
        stretch = doc[low:high]
        # Matches of this item stand on bands around the diagonals; a long stretch is gone through piece by piece.
        for k in range(0, max(1, len(stretch)), 400):
            # The one alignment with the most matches is had cheaply; where it has no run, another one may.
            piece = stretch[k : k + 600]
            if not _dense(own, piece):
                continue
            figures = ix.figure[own], ix.figure[piece]
            matches = runs_of(own, piece)
            if len(matches) < LEAST_MATCHES:
                continue  # no alignment has more
            if holds_run(matches, *figures) or aligned_run(own, piece, *figures):
                return True
    return False


def search_batch(ix: Index, ids: list[int], texts: list[list[str]]) -> list[tuple[int, int]]:
    """(document, item) of a batch of whole documents, given as their words."""
    pieces, spans, n = [], [], 0
    get, strange = ix.vocabulary.get, len(ix.vocabulary) + 1
    other = _Unknown(strange).__getitem__
    for text in texts:
        w = np.array([get(x) or other(x) for x in text], np.int32)
        spans.append((n, n + len(w)))
        pieces += [w, np.zeros(WINDOW, np.int32)]
        n += len(w) + WINDOW
    if not pieces:
        return []
    flat = np.concatenate(pieces)
    known = np.r_[0, np.cumsum((flat > 0) & (flat < strange))]
    starts = np.concatenate([np.arange(a, b - WINDOW + 1, STRIDE) if b - a >= WINDOW else np.zeros(0, np.int64) for a, b in spans])
    starts = starts[known[starts + WINDOW] - known[starts] >= NEAR] if len(starts) else starts
    if not len(starts):
        return []
    d, i = _candidates(ix, flat, starts)
    keep = _near(ix, flat, d, i)
    d, i = d[keep], i[keep]
    if not len(d):
        return []
    begin = np.array([a for a, _ in spans])
    doc = np.searchsorted(begin, d, "right") - 1
    item = ix.owner[i]
    order = np.lexsort((item, doc))
    d, i, doc, item = d[order], i[order], doc[order], item[order]
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    out = []
    for a, b in zip(edge, np.r_[edge[1:], len(d)]):
        lo, hi = spans[doc[a]]
        if _confirmed(ix, flat[lo:hi], int(item[a]), d[a:b] - lo, i[a:b]):
            out.append((ids[doc[a]], ix.item[item[a]]))
    return out


def leaked_items(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id`` of the documents that hold a passage of an item.

    ``documents``: doc_id, text. ``items``: item_id, question, answer; an item's words are those of the question, then
    of the answer. A passage is RUN or more running words of the item of which up to ALTERED may be altered, left out or
    put in. The corpus is read and split into words once; a task takes documents of about HOLD words together and goes with
    them through the items block by block, each of at most about ``block_words`` words (the size of what a task holds). Null and empty texts hold nothing; items shorter than RUN words are never found; an item
    with two rows counts with each. Repeated documents are found each.
    """
    text = F.concat_ws(" ", F.col("question"), F.col("answer"))
    sized = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (5 * block_words)))
    rows = documents.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long"
    indexes = []
    for b in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        indexes.append(documents.sparkSession.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in part])))

    def search(held: list[tuple[int, list[str]]]) -> Iterator[pd.DataFrame]:
        for index in indexes:
            ix = index.value
            for k in range(0, len(held), PIECE):
                piece = held[k : k + PIECE]
                yield pd.DataFrame(search_batch(ix, [i for i, _ in piece], [w for _, w in piece]), columns=["doc_id", "item_id"])
            if len(indexes) > 1:
                del ix
                index.__dict__.pop("_value", None)  # one block at a time in a worker

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, list[str]]] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                held.append((i, words(text)))
                size += len(held[-1][1])
                if (len(held) >= PIECE and len(indexes) == 1) or size >= HOLD:
                    yield from search(held)
                    held, size = [], 0
        yield from search(held)

    return rows.mapInPandas(run, schema).distinct()
