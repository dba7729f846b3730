"""N-gram Jaccard join: a prefix-filter join on globally ordered shingle sets, verified in prefix trees.

All sets are put in one global order, rarest shingles first, ties by fingerprint.
Two sets that are similar enough share a shingle among the first
``n - ceil(t * n) + 1`` of each, so only these prefixes are compared between
documents. Candidates are verified in prefix trees: the sets that are compared
with one set stand in a trie, which is walked once; sets that begin alike share
the count of common shingles so far, and a subtree is left as soon as the shingles
that remain can't reach the required overlap.

- Equal sets are one class; only its first document is joined.
- How often a shingle occurs is read from a sketch of ``SLOTS`` counters, a fixed
  size however large the corpus. It decides the order, hence the work, never the
  result.
- A prefix shingle's documents are first compared with one of them only, a hub.
  Links so found are contracted, and then pairs are formed of documents that
  share a prefix shingle but not yet a component. A group of near copies so costs
  one comparison each, not all pairs, and no link between components is lost.

Defined cases: null and empty texts and texts without words have an empty set and
link with nothing; a text with fewer words than a shingle has the whole sequence
as its one shingle; equal sets link; rows that repeat an id share one node;
a null id sorts first; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.components import components
from headway.llm.tables import NO_ID, keyed, map_batches, stage, to_id
from headway.llm.words import mix, slices, spans_hash
from headway.session import release, staged

SLOTS = 1 << 21
BLOCK = 1 << 14
#: Bytes of text worked on at once: a worker keeps the room of its largest arrays, and there are several on an executor.
SLICE = 400_000
GROUP_SHINGLES = 200_000


def shingle_sets(s, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of the distinct shingles of every row, by row and fingerprint."""
    at, code = s.grams(n)
    row = s.row[at]
    short = np.flatnonzero((s.n_words > 0) & (s.n_words < n))
    if len(short):
        code = np.concatenate([code, spans_hash(s.code, s.first[short], s.first[short] + s.n_words[short])])
        row = np.concatenate([row, short])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _level(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype(np.uint8)


def summarize(texts: DataFrame, n: int) -> DataFrame:
    """Per document key, th, n_shingles and a 128-bit set fingerprint; and the task's counters as rows without key."""

    def run(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for b in batches:
            for s in slices(b.column(2), lower=True, size=SLICE):
                row, code = shingle_sets(s, n)
                counts += np.bincount((code % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                first = np.searchsorted(row, np.arange(s.n_rows + 1))
                sums = []
                for salt in (0x9FB21C651E98DF25, 0xA0761D6478BD642F):
                    total = np.zeros(len(code) + 1, np.uint64)
                    np.cumsum(mix(code ^ np.uint64(salt)), out=total[1:])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                yield {
                    "key": b.column(0).slice(s.offset, s.n_rows), "th": b.column(1).slice(s.offset, s.n_rows), "n": np.diff(first),
                    "fp1": sums[0], "fp2": sums[1], "block": np.full(s.n_rows, -1), "counts": [None] * s.n_rows,
                }
        m = SLOTS // BLOCK
        none = [None] * m
        blocks = [counts[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(m)]
        yield {"key": none, "th": none, "n": none, "fp1": none, "fp2": none, "block": np.arange(m), "counts": blocks}

    return map_batches(texts, run, "key long, th long, n int, fp1 long, fp2 long, block int, counts binary")


def sketch(summary: DataFrame) -> np.ndarray:
    """Levels (log2 of the count) of all slots; the counters of a block are added up on executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string("block int, counts binary"))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in group.column("counts"))
        return pa.Table.from_pydict({"block": [group.column("block")[0].as_py()], "counts": [_level(total).tobytes()]}, schema=arrow)

    levels = np.zeros(SLOTS, np.uint8)
    for r in summary.filter("block >= 0").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return levels


def _ordered(row: np.ndarray, code: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Indices that put every row's shingles in the global order."""
    return np.lexsort((code, levels[(code % np.uint64(SLOTS)).astype(np.int64)], row))


def prefixes(texts: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """key, th, n and the first shingles of the ordered set that any partner must share one of."""

    def run(batches):
        for b in batches:
            for s in slices(b.column(2), lower=True, size=SLICE):
                row, code = shingle_sets(s, n)
                first = np.searchsorted(row, np.arange(s.n_rows + 1))
                size = np.diff(first)
                code = code[_ordered(row, code, levels.value)]
                keep = np.where(size > 0, size - (-(-percent * size // 100)) + 1, 0)
                inside = np.arange(len(code)) - first[row] < keep[row]
                bounds = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(code[inside].view(np.int64)))
                yield {"key": b.column(0).slice(s.offset, s.n_rows), "th": b.column(1).slice(s.offset, s.n_rows), "n": size, "prefix": lists}

    return map_batches(texts, run, "key long, th long, n int, prefix array<long>")


def required(na: int, nb: int, percent: int) -> int:
    """Smallest intersection with 100 * I >= percent * U."""
    return -(-percent * (na + nb) // (100 + percent))


def walk(one: np.ndarray, others: list[np.ndarray], percent: int) -> list[int]:
    """Which of ``others`` link with ``one``; sets are fingerprints in the global order.

    Sorted by their sequences, the sets are a trie in depth-first order: what two
    neighbours begin with is their common path, and its counts are kept.
    """
    member = np.sort(one)
    path = np.zeros(0, np.uint64)
    counts = np.zeros(1, np.int64)  # common shingles up to each depth of the path
    found = []
    for i in sorted(range(len(others)), key=lambda i: others[i].tobytes()):
        other = others[i]
        need = required(len(one), len(other), percent)
        k = min(len(path), len(other))
        differ = np.flatnonzero(path[:k] != other[:k])
        depth = int(differ[0]) if len(differ) else k
        path, counts = path[:depth], counts[: depth + 1]
        have = int(counts[-1])
        new = [counts]
        while depth < len(other) and have + len(other) - depth >= need:
            step = other[depth : depth + 256]
            hit = member[np.minimum(np.searchsorted(member, step), len(member) - 1)] == step
            new.append(have + np.cumsum(hit))
            have = int(new[-1][-1])
            depth += len(step)
        path, counts = other[:depth], np.concatenate(new)
        if depth == len(other) and have >= need:
            found.append(i)
    return found


def verify(texts: DataFrame, pairs: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, ath, an, b, bth, bn)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    load = pairs.groupBy("a", "ath").agg(F.ceil(F.sum("bn") / GROUP_SHINGLES).alias("parts"))
    dealt = pairs.join(load, ["a", "ath"]).withColumn("part", F.pmod(F.xxhash64("b", "bth"), F.greatest("parts", F.lit(1))))
    group = F.struct("a", "ath", "part").alias("grp")
    asked = dealt.select(F.col("b").alias("key"), F.col("bth").alias("th"), group, F.lit(True).alias("other")).unionByName(
        dealt.select("a", "ath", "part").distinct().select(F.col("a").alias("key"), F.col("ath").alias("th"), group, F.lit(False).alias("other"))
    )
    asked = asked.select("key", "th", F.col("grp.a").alias("a"), F.col("grp.ath").alias("ath"), F.col("grp.part").alias("part"), "other")
    # what is asked for grows with the corpus, so it is never broadcast
    rows = texts.join(asked.hint("merge"), ["key", "th"]).select("key", "a", "ath", "part", "other", "text")

    def sets(batches):
        for b in batches:
            for s in slices(b.column(5), lower=True, size=SLICE):
                row, code = shingle_sets(s, n)
                code = code[_ordered(row, code, levels.value)]
                first = np.searchsorted(row, np.arange(s.n_rows + 1))
                out = {name: b.column(i).slice(s.offset, s.n_rows) for i, name in enumerate(("key", "a", "ath", "part", "other"))}
                yield out | {"data": [code[first[i] : first[i + 1]].tobytes() for i in range(s.n_rows)]}

    arrow = to_arrow_schema(_parse_datatype_string("a long, b long"))

    def match(group: pa.Table) -> pa.Table:
        keys, other = group.column("key").to_pylist(), group.column("other").to_pylist()
        data = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("data")]
        one = next((d for d, o in zip(data, other) if not o), None)
        rest = [i for i, o in enumerate(other) if o]
        linked = walk(one, [data[i] for i in rest], percent) if one is not None and len(one) else []
        a = group.column("a")[0].as_py()
        return pa.Table.from_pydict({"a": [a] * len(linked), "b": [keys[rest[i]] for i in linked]}, schema=arrow)

    built = map_batches(rows, sets, "key long, a long, ath long, part long, other boolean, data binary")
    return built.groupBy("a", "ath", "part").applyInArrow(match, "a long, b long")


def _close(an: str, bn: str, percent: int):
    return 100 * F.least(an, bn) >= percent * F.greatest(an, bn)


def _in_reach(an: str, at: str, bn: str, bt: str, percent: int):
    """Whether sets whose first common shingle stands at ``at`` and ``bt`` can overlap enough."""
    left = F.least(F.col(an) - F.col(at), F.col(bn) - F.col(bt))
    return (100 + percent) * left >= percent * (F.col(an) + F.col(bn))


def _with_hub(entries: DataFrame) -> DataFrame:
    """Add ``one``: of a shingle's documents the one most of whose prefix is shared, the smallest on a tie.

    Copies that were edited each in its own way are near the text they come from
    more than near each other, and have rare shingles of their own that it lacks.
    """
    score = entries.groupBy("key", "th").agg((F.count("*") / F.max("n")).alias("score"))
    scored = entries.join(score, ["key", "th"])
    hub = scored.groupBy("gram").agg(F.min(F.struct(-F.col("score"), "key", "th", "n", "at")).alias("one"))
    one = F.struct("one.key", "one.th", "one.n", "one.at").alias("one")
    return entries.join(hub.select("gram", one), "gram")


def link(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    texts = keyed(docs)
    summary = stage(summarize(texts, n), "shingles")
    levels = spark.sparkContext.broadcast(sketch(summary))
    sizes = summary.filter("block < 0").select("key", "th", "n", "fp1", "fp2")
    classes = sizes.filter("n > 0").groupBy("n", "fp1", "fp2").agg(F.min(F.struct("key", "th")).alias("first"))
    firsts = classes.select("first.key", "first.th")
    ordered = prefixes(texts, n, percent, levels)
    entries = ordered.join(firsts, ["key", "th"]).select("key", "th", "n", F.posexplode("prefix").alias("at", "gram"))
    before = staged()
    entries = stage(entries, "entries")
    shared = entries.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1").select("gram")
    shared = stage(entries.join(shared, "gram"), "shared")
    release(spark, [p for p in staged() if p not in before][:1])  # all shingles; those shared by several documents go on
    entries = stage(_with_hub(shared), "hubs")
    same = (F.col("one.key") == F.col("key")) & (F.col("one.th") == F.col("th"))
    star = entries.filter(~same).filter(_close("one.n", "n", percent) & _in_reach("one.n", "one.at", "n", "at", percent)).select(
        F.col("one.key").alias("a"), F.col("one.th").alias("ath"), F.col("one.n").alias("an"),
        F.col("key").alias("b"), F.col("th").alias("bth"), F.col("n").alias("bn"),
    ).distinct()
    links = stage(verify(texts, stage(star, "star"), n, percent, levels).distinct(), "found")
    labels = components(links)
    rest = _between_components(entries, labels, percent)
    rest = stage(rest, "rest")
    if not rest.isEmpty():
        links = links.union(verify(texts, rest, n, percent, levels))
        labels = components(links)
    reached = labels.select(F.col("node").alias("first_key"), "component")
    whole = classes.select("n", "fp1", "fp2", F.col("first.key").alias("first_key")).join(reached, "first_key", "left")
    whole = whole.select("n", "fp1", "fp2", F.coalesce("component", "first_key").alias("component"))
    found = sizes.join(whole, ["n", "fp1", "fp2"], "left").withColumn("component", F.coalesce("component", "key"))
    return found.select(
        to_id(), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id")
    )


def _between_components(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a prefix shingle but not a component, without those that were compared already."""
    labelled = entries.join(labels.select(F.col("node").alias("key"), "component"), "key", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "key")).select("gram", "one", "key", "th", "n", "at", "component")
    mixed = labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("gram")
    left = labelled.join(mixed, "gram").filter((F.col("one.key") != F.col("key")) | (F.col("one.th") != F.col("th")))
    a = left.select("gram", F.col("key").alias("a"), F.col("th").alias("ath"), F.col("n").alias("an"), F.col("at").alias("ai"), F.col("component").alias("ac"))
    b = left.select("gram", F.col("key").alias("b"), F.col("th").alias("bth"), F.col("n").alias("bn"), F.col("at").alias("bi"), F.col("component").alias("bc"))
    pairs = a.join(b, "gram").filter("ac <> bc AND (a < b OR (a = b AND ath < bth))").filter(_close("an", "bn", percent) & _in_reach("an", "ai", "bn", "bi", percent))
    return pairs.select("a", "ath", "an", "b", "bth", "bn").distinct()
