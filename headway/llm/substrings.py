"""Substring dedup: repeated windows of words, found by hash at sampled suffixes; no suffix tree is built.

A window of ``size`` words is a path from the root of the suffix tree of all
documents; it occurs again where that path ends at or above an inner node. The
tree is never built whole. Suffixes are split by prefix, in two lengths:

1. Short prefixes (``SEED`` words), taken at the sampled suffixes of a text: of
   the prefixes that start in a window, the one with the smallest fingerprint.
   Equal windows sample the same prefix at the same place, so a prefix that
   occurs once in the corpus heads no inner node deep enough, and its suffixes
   are dropped. What is left is little more than the repeated text.
2. Full prefixes (``size`` words) of the suffixes that are left. They go to
   memory-sized groups; a group sorts its paths, so the leaves below one node are
   neighbours, and every leaf but the first in document order is reported.

Paths are compared by 128-bit fingerprints. A task first collapses what repeats
among its own rows and reports it at once, so a passage that stands in a third of
all documents reaches its group as one leaf per task. Whole copies of a text are
set aside before: all their windows start earlier in the first copy.

Defined cases: null text has no words; fewer than ``size`` words can't repeat;
rows that repeat an id count as one document if their texts are equal, else as
documents in the order of their text hash; a null id sorts first; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import group_count, keyed, map_batches, to_id
from headway.llm.words import mix, slices

SIZE = 20
SEED = 8
GROUP_BYTES = 16_000_000
FLUSH = 1_000_000
_SECOND = 0xC2B2AE3D27D4EB4F

#: Leaves of a group (part >= 0) or reports for a share of the documents (part < 0).
PACKED = "part int, data binary"


def seeds(code: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: its first word, and where in it the sampled prefix starts. ``code``: prefix fingerprint at each word."""
    reach = size - SEED + 1
    n = len(row) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[size - 1 :] == row[:n])
    best, where = code[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, reach):
        less = code[k : k + n] < best
        np.copyto(best, code[k : k + n], where=less)
        where[less] = k
    return at, at + where[at]


def _prefix_codes(s) -> np.ndarray:
    """Fingerprint of the ``SEED`` words from each word on; the largest value where the text ends before."""
    out = np.full(len(s.row), np.iinfo(np.uint64).max, np.uint64)
    at, code = s.grams(SEED)
    out[at] = code
    return out


class Leaves:
    """Leaves of one task: (path, document, word). Sorts them, reports local repeats, packs the rest by group."""

    def __init__(self, groups: int, wide: bool):
        self.groups, self.wide, self.parts, self.held = groups, wide, [], 0
        self.docs: list[tuple[int, int]] = []

    def add(self, paths: list[np.ndarray], docs: list[tuple[int, int]], doc: np.ndarray, word: np.ndarray) -> None:
        self.parts.append((*paths, doc.astype(np.int64) + len(self.docs), word))
        self.docs += docs
        self.held += len(word)

    def flush(self):
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        docs = np.array(self.docs, np.int64).reshape(-1, 2)
        self.parts, self.docs, self.held = [], [], 0
        paths, doc, word = columns[:-2], columns[-2], columns[-1]
        first, repeat = leaves_in_order(paths, docs, doc, word)
        yield from reports(docs, doc, word, repeat if self.wide else repeated_everywhere(paths, first, repeat), self.groups)
        part = (paths[0][first] % np.uint64(self.groups)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        first, part = first[by_part], part[by_part]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for chunk in np.split(first, cuts):
            chunk = np.sort(chunk)
            used, index = np.unique(doc[chunk], return_inverse=True)
            yield {
                "part": [int(paths[0][chunk[0]] % np.uint64(self.groups))],
                "data": [pack([p[chunk] for p in paths], docs[used], index, word[chunk])],
            }


def pack(paths, docs, index, word) -> bytes:
    head = np.array([len(word), len(docs), len(paths)], np.int64)
    return b"".join(x.tobytes() for x in (head, docs, index.astype(np.int32), word.astype(np.int32), *paths))


def unpack(data: bytes):
    n, d, p = np.frombuffer(data, np.int64, 3)
    at = 24
    docs = np.frombuffer(data, np.int64, 2 * d, at).reshape(-1, 2)
    at += 16 * d
    index = np.frombuffer(data, np.int32, n, at)
    word = np.frombuffer(data, np.int32, n, at + 4 * n)
    at += 8 * n
    return [np.frombuffer(data, np.uint64, n, at + 8 * n * i) for i in range(p)], docs, index, word


def leaves_in_order(paths, docs, doc, word) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first leaf below each path, in document order, and of all others."""
    place = np.lexsort((docs[:, 1], docs[:, 0]))
    rank = np.empty(len(docs), np.int64)
    # one document may stand in several lists: equal ids get equal ranks
    ordered = docs[place]
    rank[place] = np.cumsum(np.r_[0, np.any(ordered[1:] != ordered[:-1], axis=1)]) if len(docs) else 0
    order = np.lexsort((word, rank[doc], *reversed(paths)))
    path = np.zeros(len(order), bool)  # differs from the one before
    leaf = np.zeros(len(order), bool)
    path[:1] = leaf[:1] = True
    for p in paths:
        path[1:] |= p[order][1:] != p[order][:-1]
    for p in (rank[doc][order], word[order]):
        leaf[1:] |= p[1:] != p[:-1]
    # a row that repeats id and text repeats leaves, not content
    return order[path], order[leaf & ~path]


def repeated_everywhere(paths, first, repeat) -> np.ndarray:
    """All leaves of paths that occur twice, the first included."""
    often = np.isin(paths[0][first], paths[0][repeat])
    return np.concatenate([first[often], repeat])


def reports(docs, doc, word, which, groups: int):
    """Word positions by document, packed for the share of the documents that each belongs to.

    There is one share to four groups: positions are small, and fewer shares make fewer packets.
    """
    shares = max(1, groups // 4)
    if not len(which):
        return
    which = which[np.lexsort((word[which], doc[which]))]
    share = (mix(docs[:, 0].view(np.uint64) ^ mix(docs[:, 1].view(np.uint64))) % np.uint64(shares)).astype(np.int64)[doc[which]]
    order = np.argsort(share, kind="stable")
    for chunk in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
        used, index = np.unique(doc[which[chunk]], return_inverse=True)
        yield {"part": [-1 - int(share[chunk[0]])], "data": [pack([], docs[used], index, word[which[chunk]])]}


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _unpacked(group: pa.Table):
    """All leaves of a group: paths, documents, document of each leaf, word."""
    paths, docs, doc, word, base = [], [], [], [], 0
    for data in group.column("data"):
        p, d, i, w = unpack(data.as_py())
        paths.append(p)
        docs.append(d)
        doc.append(i.astype(np.int64) + base)
        word.append(w)
        base += len(d)
    return [np.concatenate(c) for c in zip(*paths)], np.concatenate(docs), np.concatenate(doc), np.concatenate(word)


def _gather(rows: DataFrame, wide: bool, groups: int) -> DataFrame:
    """Leaves by group to (key, th, found): packed positions of each document that has any."""
    packed, merged = _arrow(PACKED), _arrow("key long, th long, found binary")

    def find(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() < 0:
            return group.select(packed.names)  # reported by a task already
        paths, docs, doc, word = _unpacked(group)
        first, repeat = leaves_in_order(paths, docs, doc, word)
        out = list(reports(docs, doc, word, repeat if wide else repeated_everywhere(paths, first, repeat), groups))
        return pa.Table.from_pydict({k: [r[k][0] for r in out] for k in packed.names}, schema=packed)

    def merge(group: pa.Table) -> pa.Table:
        _, docs, doc, word = _unpacked(group)
        place = np.lexsort((docs[:, 1], docs[:, 0]))
        new = np.r_[True, np.any(docs[place][1:] != docs[place][:-1], axis=1)]
        rank = np.empty(len(docs), np.int64)
        rank[place] = np.cumsum(new) - 1
        found = np.unique((rank[doc] << 32) | word)
        owner = found >> 32
        parts = np.split((found & 0xFFFFFFFF).astype(np.int32), np.flatnonzero(np.diff(owner)) + 1)
        ids = docs[place][new][np.unique(owner)]
        return pa.Table.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([x.tobytes() for x in parts], pa.binary())], schema=merged)

    reported = rows.groupBy("part").applyInArrow(find, PACKED)
    return reported.groupBy("part").applyInArrow(merge, "key long, th long, found binary")


def _positions(found) -> np.ndarray:
    return np.frombuffer(found.as_py(), np.int32)


def repeated_windows(texts: DataFrame, size: int, groups: int) -> DataFrame:
    """(key, th, found): packed first words of windows that also start earlier; ``texts`` has (key, th, text), first copies only as flagged."""

    def sample(batches):
        leaves = Leaves(groups, False)
        for b in batches:
            key, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in slices(b.column(2)):
                code = _prefix_codes(s)
                _, at = seeds(code, s.row, size)
                at = np.unique(at)
                docs = list(zip(key[s.offset : s.offset + s.n_rows].tolist(), th[s.offset : s.offset + s.n_rows].tolist()))
                leaves.add([code[at]], docs, s.row[at], at - s.first[s.row[at]])
                if leaves.held >= FLUSH:
                    yield from leaves.flush()
        yield from leaves.flush()

    def full(batches):
        leaves = Leaves(groups, True)
        for b in batches:
            key, th, found = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for s in slices(b.column(2)):
                start, at = seeds(_prefix_codes(s), s.row, size)
                known = np.zeros(len(s.row), bool)
                for i in range(s.n_rows):
                    known[s.first[i] + _positions(found[s.offset + i])] = True
                start = start[known[at]]
                two = [s_hash(s, start, size), s_hash(s, start, size, _SECOND)]
                docs = list(zip(key[s.offset : s.offset + s.n_rows].tolist(), th[s.offset : s.offset + s.n_rows].tolist()))
                leaves.add(two, docs, s.row[start], start - s.first[s.row[start]])
                if leaves.held >= FLUSH:
                    yield from leaves.flush()
        yield from leaves.flush()

    seeded = _gather(map_batches(texts.filter("original").select("key", "th", "text"), sample, PACKED), False, groups)
    left = texts.select("key", "th", "text").join(seeded.hint("shuffle_hash"), ["key", "th"]).select("key", "th", "text", "found")
    return _gather(map_batches(left, full, PACKED), True, groups)


def s_hash(s, start: np.ndarray, size: int, base: int | None = None) -> np.ndarray:
    from headway.llm.words import _BASE, spans_hash

    return spans_hash(s.code, start, start + size, base or _BASE)


def dedup(docs: DataFrame, size: int = SIZE, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words as ``text`` where asked for."""
    rows = keyed(docs)
    groups = group_count(docs, GROUP_BYTES)
    firsts = rows.groupBy(F.md5("text").alias("digest")).agg(F.min(F.struct("key", "th")).alias("f")).select("f.key", "f.th", F.lit(True).alias("original"))
    texts = rows.join(firsts.hint("shuffle_hash"), ["key", "th"], "left").select("key", "th", "text", F.coalesce("original", F.lit(False)).alias("original"))
    found = repeated_windows(texts, size, groups)
    joined = texts.join(found.hint("shuffle_hash"), ["key", "th"], "left").select("key", "text", "original", "found")
    schema = "key long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")

    def run(batches):
        for b in batches:
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
            for text, original, at in zip(b.column(1), b.column(2).to_pylist(), b.column(3)):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n = len(words)
                if not original and n >= size:
                    words = []
                elif at.is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    start = _positions(at)
                    edge[start] += 1
                    edge[start + size] -= 1
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["text"].append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            yield {"key": b.column(0)} | out

    done = map_batches(joined, run, schema)
    return done.select(to_id(), *[c for c in done.columns if c != "key"])
