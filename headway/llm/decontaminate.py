"""Benchmark decontamination: word seeds find passages, Smith-Waterman scores them.

Seeds are the n-grams of words of the benchmark items, all of them: however often
an item is copied, an edited copy is found by whatever seeds it keeps (one that keeps
no three words in a row is not found, whatever it would score). A pass finds
the seeds in all documents and cuts out the stretch of words around each diagonal
that they lie on. A stretch whose words, counted with repeats, are too few of the
item's to reach the threshold even if all matched is dropped; the others are
aligned with the item. The score is the best local alignment over that of the item
with itself.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, one pass
each, so what is sent to tasks is bounded however long it is; every item
meets every document.

Defined cases: words are lower-cased and carry no punctuation; a character of a
script without spaces is a word; a text of any length is searched whole; null and empty
texts and items match nothing; an item shorter than a seed has its whole sequence
as its only seed; rows that repeat an id are searched each, the best score of an
id and item counts, of equal scores the first stretch; a null id is an id of its own; further columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.lines import BREAKS
from headway.llm.tables import free_name, map_batches
from headway.llm.words import slices, spans_hash

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16_000_000
#: Seed hits, each with every item that has the seed, that are looked at together.
HITS = 2_000_000
#: Words of stretches, padded to the longest, that are aligned together; a longer stretch is aligned alone.
CELLS = 1_000_000


class Items:
    """Word codes of a block of items, and their seeds in order of fingerprint."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.words = ids, []
        code, item, place = [], [], []
        at = 0
        for s in slices(pa.array(texts, pa.string()), BREAKS, lower=True, characters=True):
            for i in range(s.n_rows):
                w = s.code[s.first[i] : s.first[i + 1]]
                self.words.append(w)
                n = min(SEED, len(w))
                if n:
                    start = np.arange(len(w) - n + 1)
                    code.append(spans_hash(w, start, start + n))
                    item.append(np.full(len(start), at))
                    place.append(start)
                at += 1
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        code, item, place = join(code, np.uint64), join(item, np.int64), join(place, np.int64)
        order = np.lexsort((place, item, code))
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.seed, self.first = np.unique(self.code, return_index=True)
        self.lengths = sorted({min(SEED, len(w)) for w in self.words if len(w)})

    def hits(self, s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word in the slice, seed) of all seeds in a slice."""
        rows, words, seeds = [], [], []
        for n in self.lengths:
            at, code = s.grams(n)
            k = np.minimum(np.searchsorted(self.seed, code), max(len(self.seed) - 1, 0))
            hit = np.flatnonzero(self.seed[k] == code) if len(self.seed) else np.zeros(0, np.int64)
            rows.append(s.row[at[hit]])
            words.append(at[hit])
            seeds.append(k[hit])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(rows), join(words), join(seeds)


def shared(item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """How many of an item's words, counted with repeats, each stretch has: no alignment matches more."""
    words, count = np.unique(item, return_counts=True)
    size = np.array([len(w) for w in windows])
    code, of = np.concatenate(windows), np.repeat(np.arange(len(windows)), size)
    k = np.minimum(np.searchsorted(words, code), len(words) - 1)
    hit = words[k] == code
    has = np.bincount(of[hit] * len(words) + k[hit], minlength=len(windows) * len(words)).reshape(len(windows), -1)
    return np.minimum(has, count).sum(axis=1)


def align(item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores of one item with many stretches, one vector step per item word."""
    width = max(map(len, windows))
    grid = np.zeros((len(windows), width), np.uint64)
    inside = np.zeros((len(windows), width), bool)
    for i, w in enumerate(windows):
        grid[i, : len(w)], inside[i, : len(w)] = w, True
    slope = -GAP * np.arange(width)
    above = np.zeros((len(windows), width + 1), np.int32)
    best = np.zeros(len(windows), np.int32)
    for word in item:
        step = np.where(inside & (grid == word), MATCH, MISMATCH)
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        above[:, 1:] = row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _by_item(item: np.ndarray, size: np.ndarray):
    """Indices of equal items with stretches of about one size, as many at a time as ``CELLS`` words hold, padded to the longest."""
    order = np.lexsort((size, item))
    for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
        at = 0
        while at < len(part):
            # sizes ascend: the last one taken is the width of all
            taken = np.flatnonzero(size[part[at:]] * np.arange(1, len(part) - at + 1) <= CELLS)
            to = at + max(1, int(taken[-1]) + 1 if len(taken) else 1)
            yield part[at:to]
            at = to


def _stretches(items: Items, s, threshold: float):
    """(row, item, first word, end) around the diagonals that seeds lie on, where enough of the item's words are."""
    row, word, seed = items.hits(s)
    end = np.append(items.first[1:], len(items.code))
    size = end[seed] - items.first[seed]
    length = np.array([len(w) for w in items.words], np.int64)
    found = [(np.zeros(0, np.int64),) * 4]
    for at in np.split(np.arange(len(seed)), np.flatnonzero(np.diff(np.cumsum(size) // HITS)) + 1) if len(seed) else []:
        n = size[at]
        entry = np.repeat(items.first[seed[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        r, item = np.repeat(row[at], n), items.item[entry]
        diagonal = np.repeat(word[at], n) - items.place[entry]
        r, item, diagonal = np.unique(np.stack([r, item, diagonal]), axis=1)
        slack = length[item] // 2 + 2
        low = np.maximum(diagonal - slack, s.first[r])
        high = np.minimum(diagonal + length[item] + slack, s.first[r + 1])
        ok = np.zeros(len(r), bool)
        for of in _by_item(item, high - low):
            words = items.words[item[of[0]]]
            ok[of] = shared(words, [s.code[low[i] : high[i]] for i in of]) >= threshold * len(words)
        found.append((r[ok], item[ok], low[ok], high[ok]))
    row, item, low, high = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((low, item, row))
    row, item, low, high = row[order], item[order], low[order], high[order]
    # stretches whose starts lie within half an item of each other become one
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] - low[:-1] > length[item[1:]] // 2)
    start = np.flatnonzero(new)
    return row[start], item[start], low[start], np.maximum.reduceat(high, start) if len(start) else high


def _block(docs: DataFrame, ids: list, texts: list[str], threshold: float) -> DataFrame:
    def search(batches):
        items = Items(ids, texts)
        for b in batches:
            for s in slices(b.column(1), BREAKS, lower=True, characters=True):
                row, item, low, high = _stretches(items, s, threshold)
                found = []
                for at in _by_item(item, high - low):
                    words = items.words[item[at[0]]]
                    scores = align(words, [s.code[low[i] : high[i]] for i in at]) / (MATCH * len(words))
                    found += [(i, x) for i, x in zip(at.tolist(), scores.tolist()) if x >= threshold]
                at = np.array([i for i, _ in found], np.int64)
                yield {
                    "doc_id": b.column(0).take(pa.array(s.offset + row[at])), "item_id": [ids[i] for i in item[at]],
                    "score": [x for _, x in found], "first_word": low[at] - s.first[row[at]], "n_words": high[at] - low[at],
                }

    return map_batches(docs, search, "doc_id long, item_id long, score double, first_word long, n_words long")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, item_id and the best alignment: score, and the stretch of words (from 0) it was found in."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else 1
    found = None
    for i in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect() if blocks > 1 else bench.collect()
        part.sort(key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
        one = _block(docs, [r["item_id"] for r in part], [r["text"] for r in part], threshold)
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("score", -F.col("first_word"), "n_words"))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", "best.score", (-F.col("best.col2")).alias("first_word"), "best.n_words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    found = free_name(docs, "found")
    ids = matches(docs, benchmark).select(F.col("doc_id").alias(found)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(found)), "left_anti")
