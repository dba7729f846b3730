"""Phrase collocations per language, counted in weighted acyclic automata.

A shard of texts sorts its word sequences and builds an automaton from them: a
sequence adds states only behind the prefix it shares with the one before it, and
a final state carries the count. Automata travel by prefix and range of the last
word; union adds up the counts of a range. The label before the first word is the
language, so the count of a language alone is its number of words.

Lengths are counted in passes over whole texts. A sequence is only counted where
its parts of the pass before may be frequent, which a bitmap of fixed size tells:
it may let too many through, never too few. The parts of a candidate are looked up
by composing: a shard of candidates asks for each part once, the automaton of the
part's range answers, and the answers are an automaton again.

Words are 64-bit fingerprints on the way. Two words with one fingerprint are found
while words are counted, and another base is taken then, so counts are exact.

Defined cases: null text has no words; null language is ``und``; a phrase does not
leave its piece; rows that repeat are counted each; phrases that tie in score and
count go by their bytes; a text of any length is read whole, a long word too;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.tables import map_batches, stage
from headway.llm.words import _VALUES, SPACES, mix, slices, spans_hash
from headway.session import release, staged

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = SPACES | ENDS
SHARD_WORDS = 2_000_000
GROUP_BYTES = 8_000_000
FILTER_BITS = 1 << 25
SHARD_ROWS = 100_000
SECOND = 0x9FB21C651E98DF25
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
CODES = [f"c{i}" for i in range(1, LONGEST + 1)]
COUNTS = "m int, lang_code long, " + ", ".join(f"{c} long" for c in CODES) + ", f long, b1 long, b2 long, word string, clash boolean"
PACKETS = "part long, shard long, data binary"
SCORED = "m int, lang_code long, " + ", ".join(f"{c} long" for c in CODES) + ", a long, l long, r long, n long, score long, prefix boolean, suffix boolean"


class Transducer:
    """Layer j holds the states after j + 1 labels, in order: the state each continues, its label; final states have a weight."""

    def __init__(self, up: list[np.ndarray], label: list[np.ndarray], weight: np.ndarray):
        self.up, self.label, self.weight = up, label, weight

    @classmethod
    def build(cls, columns: list[np.ndarray], weight: np.ndarray) -> tuple[Transducer, np.ndarray]:
        """From sequences, one array per place; equal ones add up. Also the index of a row of each."""
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        up, label, state = [], [], np.zeros(len(order), np.int64)
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]  # states are shared up to the first label that differs
            up.append(state[new])
            label.append(c[new])
            state = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return cls(up, label, np.add.reduceat(weight[order], at) if len(at) else weight[:0]), order[at]

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        return cls.build([np.concatenate(c) for c in zip(*[p.columns() for p in parts])], np.concatenate([p.weight for p in parts]))[0]

    def columns(self) -> list[np.ndarray]:
        """The labels of all sequences, one array per place."""
        out, at = [self.label[-1]], self.up[-1]
        for up, label in zip(self.up[-2::-1], self.label[-2::-1]):
            out.append(label[at])
            at = up[at]
        return out[::-1]

    def weights(self, columns: list[np.ndarray]) -> np.ndarray:
        """The weight of each given sequence, 0 where there is no such path."""
        known, state = np.full(len(columns[0]), len(self.weight) > 0), np.zeros(len(columns[0]), np.int64)
        for up, label, c in zip(self.up, self.label, columns) if len(self.weight) else ():
            low, high = np.searchsorted(up, state), np.searchsorted(up, state, "right")
            last = len(label) - 1
            while (open_ := low < high).any():
                middle = (low + high) // 2
                less = open_ & (label[np.minimum(middle, last)] < c)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            low = np.minimum(low, last)
            known &= (up[low] == state) & (label[low] == c)
            state = np.where(known, low, 0)
        return np.where(known, self.weight[state], 0) if len(self.weight) else np.zeros(len(known), np.int64)

    def pack(self) -> bytes:
        """Sizes, then per layer the number of successors of each state before it, and the labels."""
        weight = self.weight.astype(np.min_scalar_type(int(self.weight.max(initial=0))))
        parts = [np.array([len(self.label), weight.itemsize, *map(len, self.label)], np.int64)]
        for j, label in enumerate(self.label):
            if j:
                parts.append(np.bincount(self.up[j], minlength=len(self.label[j - 1])).astype(np.uint32))
            parts.append(label)
        return b"".join(p.tobytes() for p in (*parts, weight))

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Transducer, int]:
        """The automaton, and where it ends."""
        depth, width = np.frombuffer(data, np.int64, 2).tolist()
        sizes = np.frombuffer(data, np.int64, depth, 16).tolist()
        at, up, label = 16 + 8 * depth, [], []
        for j, size in enumerate(sizes):
            if j:
                fan = np.frombuffer(data, np.uint32, sizes[j - 1], at)
                at += fan.nbytes
                up.append(np.repeat(np.arange(len(fan)), fan))
            else:
                up.append(np.zeros(size, np.int64))
            label.append(np.frombuffer(data, np.uint64, size, at))
            at += 8 * size
        weight = np.frombuffer(data, f"u{width}", sizes[-1], at)
        return cls(up, label, weight.astype(np.int64)), at + weight.nbytes


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """One number per sequence; order matters."""
    out = np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for c in columns:
        out = mix(out + c)
    return out


def route(columns: list[np.ndarray], groups: int) -> np.ndarray:
    """Group of each sequence: those with one prefix and one of 16 ranges of the last label meet, so that a frequent prefix is spread."""
    return ((chain(columns[:-1]) + (columns[-1] >> np.uint64(60))) % np.uint64(groups)).astype(np.int64)


def probes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the bitmap."""
    h = chain(columns)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _marked(bitmap: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    a, b = probes(columns)
    return ((bitmap[a >> 6] >> (a & 63).astype(np.uint64)) & (bitmap[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _split(columns: list[np.ndarray], groups: int):
    """(group, row numbers) of sequences by route."""
    part = route(columns, groups)
    order = np.argsort(part, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(rows):
            yield int(part[rows[0]]), rows


def _texts(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(_lang_code(seed), F.col("text").cast("string").alias("text"))


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))


def _lang_code(seed: int) -> Column:
    return F.xxhash64(_language(), F.lit(seed)).alias("lang_code")


def _slices(batches, base: int):
    """(slice, fingerprints, language of each word, piece of each word) of every slice of the batches."""
    for b in batches:
        lang = b.column(0).to_numpy().view(np.uint64)
        for s in slices(b.column(1), BREAKS, lower=True):
            code = spans_hash(_VALUES[s._bytes], s.start, s.end, base)
            yield s, code, lang[s.offset + s.row], np.cumsum(ENDS[s.data])[s.start] + s.row


def count_words(texts: DataFrame, base: int, groups: int, least: int) -> DataFrame:
    """Rows of ``COUNTS``: frequent words (m = 1) and, by group, the words of a language (m = 0); ``clash`` where two words share a fingerprint."""

    def shard(held):
        langs, codes, others, counts, sizes, raws = (np.concatenate(x) for x in zip(*held))
        start = np.cumsum(sizes) - sizes
        kept, at = Transducer.build([langs, codes, others], counts)
        columns = kept.columns()
        for part, rows in _split(columns[:2], groups):
            some, _ = Transducer.build([c[rows] for c in columns], kept.weight[rows])
            where = at[rows]  # rows ascend, so this is the order of the automaton
            words = sizes[where].astype(np.uint32).tobytes() + _gather(raws, start[where], sizes[where]).tobytes()
            yield {"part": [part], "shard": [0], "data": [some.pack() + words]}

    def run(batches):
        held, n = [], 0
        for s, code, lang, _ in _slices(batches, base):
            # words with one fingerprint stay apart by a second one until they have been compared
            other = spans_hash(_VALUES[s._bytes], s.start, s.end, SECOND)
            kept, at = Transducer.build([lang, code, other], np.ones(len(code), np.int64))
            size = s.end[at] - s.start[at]
            held.append((*kept.columns(), kept.weight, size, _gather(s._bytes, s.start[at], size)))
            n += len(at)
            if n >= SHARD_WORDS:
                yield from shard(held)
                held, n = [], 0
        if n:
            yield from shard(held)

    def merge(group: pa.Table) -> pa.Table:
        parts, sizes, raws = [], [], []
        for data in group.column("data"):
            data = data.as_py()
            t, at = Transducer.unpack(data)
            parts.append(t)
            sizes.append(np.frombuffer(data, np.uint32, len(t.weight), at).astype(np.int64))
            raws.append(np.frombuffer(data, np.uint8, -1, at + 4 * len(t.weight)))
        size, raw = np.concatenate(sizes), np.concatenate(raws)
        end = np.cumsum(size)
        columns = [np.concatenate(c) for c in zip(*[p.columns() for p in parts])]
        weight = np.concatenate([p.weight for p in parts])
        total, first = Transducer.build(columns[:2], weight)
        clash = len(Transducer.build(columns, weight)[1]) > len(first)
        keep = np.flatnonzero(total.weight >= least)
        words = [raw[end[i] - size[i] : end[i]].tobytes().decode("utf-8", "replace") for i in first[keep].tolist()]
        found = [c[keep] for c in total.columns()]
        langs, which = np.unique(total.columns()[0], return_inverse=True)
        spoken = np.zeros(len(langs), np.int64)
        np.add.at(spoken, which, total.weight)
        return pa.concat_tables([_counts([langs], spoken, clash=clash), _counts(found, total.weight[keep], words)])

    return map_batches(texts, run, PACKETS).groupBy("part").applyInArrow(merge, COUNTS)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    """A schema of simple columns, in a task too."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (column.split() for column in text.split(", "))])


def _named(columns: list[np.ndarray]) -> dict:
    n = len(columns[0])
    codes = [columns[i] if i < len(columns) else np.zeros(n, np.uint64) for i in range(1, LONGEST + 1)]
    return {"m": np.full(n, len(columns) - 1, np.int32), "lang_code": columns[0].view(np.int64)} | {c: x.view(np.int64) for c, x in zip(CODES, codes)}


def _counts(columns: list[np.ndarray], f: np.ndarray, words=None, clash: bool = False) -> pa.Table:
    b1, b2 = probes(columns)
    n = len(f)
    return pa.table(_named(columns) | {"f": f, "b1": b1, "b2": b2, "word": words or [None] * n, "clash": [clash] * n}, schema=_schema(COUNTS))


def count_phrases(texts: DataFrame, base: int, lengths: list[int], bitmap, known: int, groups: int, least: int) -> DataFrame:
    """Rows of ``COUNTS`` for the frequent phrases of the lengths, whose parts of ``known`` words are all marked in the bitmap."""

    def shard(held, marks):
        lang, code, piece = (np.concatenate(x) for x in zip(*held))
        window = lambda at, size: [lang[at], *[code[at + i] for i in range(size)]]
        at = np.arange(len(code) - known + 1)
        good = np.zeros(len(code), bool)
        at = at[piece[at] == piece[at + known - 1]]
        good[at] = _marked(marks, window(at, known))
        for size in lengths:
            at = np.flatnonzero(good[: max(0, len(code) - size + 1)])
            at = at[piece[at] == piece[at + size - 1]]
            for i in range(1, size - known + 1):
                at = at[good[at + i]]
            if not len(at):
                return
            kept, _ = Transducer.build(window(at, size), np.ones(len(at), np.int64))
            columns = kept.columns()
            for part, rows in _split(columns, groups):
                yield {"part": [size * groups + part], "shard": [0], "data": [Transducer.build([c[rows] for c in columns], kept.weight[rows])[0].pack()]}

    def run(batches):
        marks = np.frombuffer(bitmap.value, np.uint64)
        held, n, pieces = [], 0, 0
        for _, code, lang, piece in _slices(batches, base):
            if not len(code):
                continue
            held.append((lang, code, piece + pieces))
            pieces += int(piece[-1]) + 1
            n += len(code)
            if n >= SHARD_WORDS:
                yield from shard(held, marks)
                held, n = [], 0
        if n:
            yield from shard(held, marks)

    def merge(group: pa.Table) -> pa.Table:
        total = Transducer.union([Transducer.unpack(data.as_py())[0] for data in group.column("data")])
        keep = total.weight >= least
        return _counts([c[keep] for c in total.columns()], total.weight[keep])

    return map_batches(texts, run, PACKETS).groupBy("part").applyInArrow(merge, COUNTS)


def bitmap_of(counts: DataFrame):
    """The bitmap of the counted sequences, for the tasks: ``FILTER_BITS`` bits whatever their number."""
    bit = F.explode(F.array("b1", "b2")).alias("bit")
    words = counts.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return counts.sparkSession.sparkContext.broadcast(out.tobytes())


def _columns_of(table, size: int, where=None) -> list[np.ndarray]:
    take = lambda name: np.ascontiguousarray(table.column(name).to_numpy()).view(np.uint64)
    out = [take("lang_code"), *[take(c) for c in CODES[:size]]]
    return out if where is None else [c[where] for c in out]


def _by_length(table):
    m = table.column("m").to_numpy()
    for size in np.unique(m).tolist():
        yield size, np.flatnonzero(m == size)


def score(counts: DataFrame, shards: int, groups: int) -> DataFrame:
    """Rows of ``SCORED`` for the candidates among the counted sequences: the lowest-scoring cut, and whether a part of one word less is as frequent."""
    spread = F.pmod(F.xxhash64("lang_code", *CODES), F.lit(shards)).alias("shard")
    packets = _schema(PACKETS)

    def have(batches):
        for b in batches:
            for size, rows in _by_length(b):
                columns, f = _columns_of(b, size, rows), b.column("f").to_numpy()[rows]
                for part, some in _split(columns, groups):
                    yield {"part": [size * groups + part], "shard": [-1], "data": [Transducer.build([c[some] for c in columns], f[some])[0].pack()]}

    def ask(group: pa.Table) -> pa.Table:
        shard, asked, out = group.column("shard")[0].as_py(), {}, []
        for size, rows in _by_length(group):
            columns, f = _columns_of(group, size, rows), group.column("f").to_numpy()[rows]
            out.append((-1 - shard, Transducer.build(columns, f)[0]))
            asked.setdefault(0, []).append(columns[:1])
            for k in range(1, size):
                asked.setdefault(k, []).append(columns[: k + 1])
                asked.setdefault(size - k, []).append([columns[0], *columns[k + 1 :]])
        for size, parts in asked.items():
            columns = [np.concatenate(c) for c in zip(*parts)]
            columns = Transducer.build(columns, np.zeros(len(columns[0]), np.int64))[0].columns()
            for part, some in _split(columns, groups):
                out.append((size * groups + part, Transducer.build([c[some] for c in columns], np.zeros(len(some), np.int64))[0]))
        return pa.table({"part": [p for p, _ in out], "shard": [shard] * len(out), "data": [t.pack() for _, t in out]}, schema=packets)

    def answer(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() < 0:
            return group
        shard = group.column("shard").to_numpy()
        held = [Transducer.unpack(x.as_py())[0] for x in group.column("data").filter(pa.array(shard < 0))]
        if not held:
            return packets.empty_table()
        counts, out = Transducer.union(held), []
        for who, data in zip(shard.tolist(), group.column("data")):
            if who >= 0:
                asked = Transducer.unpack(data.as_py())[0]
                out.append((who, Transducer(asked.up, asked.label, counts.weights(asked.columns())).pack()))
        return pa.table({"part": [0] * len(out), "shard": [w for w, _ in out], "data": [d for _, d in out]}, schema=packets)

    def judge(group: pa.Table) -> pa.Table:
        own, got = [], {}
        for part, data in zip(group.column("part").to_pylist(), group.column("data")):
            t = Transducer.unpack(data.as_py())[0]
            own.append(t) if part < 0 else got.setdefault(len(t.label) - 1, []).append(t)
        got = {size: Transducer.union(parts) for size, parts in got.items()}
        out = []
        for t in own:
            columns, a = t.columns(), t.weight
            size = len(columns) - 1
            n = got[0].weights(columns[:1])
            best = None
            for k in range(1, size):
                l, r = got[k].weights(columns[: k + 1]), got[size - k].weights([columns[0], *columns[k + 1 :]])  # noqa: E741
                value = 1000 * a.astype(object) * n // (l.astype(object) * r)  # Python integers: products may pass 64 bits
                if best is None:
                    best = [value.astype(np.int64), l, r]
                    suffix = r == a
                else:
                    better = value < best[0]
                    best = [np.where(better, x, y).astype(np.int64) for x, y in zip((value, l, r), best)]
                prefix = l == a
            out.append(pa.table(_named(columns) | {"a": a, "l": best[1], "r": best[2], "n": n, "score": best[0], "prefix": prefix, "suffix": suffix}, schema=_schema(SCORED)))
        return pa.concat_tables(out) if out else _schema(SCORED).empty_table()

    asked = counts.filter("m >= 2").select("m", "lang_code", *CODES, "f", spread).groupBy("shard").applyInArrow(ask, PACKETS)
    held = map_batches(counts.select("m", "lang_code", *CODES, "f"), have, PACKETS)
    return held.union(asked).groupBy("part").applyInArrow(answer, PACKETS).groupBy("shard").applyInArrow(judge, SCORED)


def inside_longer(scored: DataFrame) -> DataFrame:
    """The sequences that stand in a candidate one word longer and are not more frequent; with longer ones it follows step by step."""
    before = scored.filter("prefix AND m > 2").select("lang_code", *[F.when(F.col("m") == i + 1, F.lit(0)).otherwise(F.col(c)).alias(c) for i, c in enumerate(CODES)])
    behind = scored.filter("suffix AND m > 2").select("lang_code", *[F.col(c).alias(CODES[i]) for i, c in enumerate(CODES[1:])], F.lit(0).cast("long").alias(CODES[-1]))
    return before.union(behind).distinct()


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, count and bytes."""
    if not 2 <= longest <= LONGEST or least < 1:
        raise ValueError(f"phrases have 2 to {LONGEST} words, and occur")
    spark = docs.sparkSession
    others = set(staged())
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-size // GROUP_BYTES))
    for base in BASES:
        texts = _texts(docs, base & 0x7FFFFFFF)
        words = stage(count_words(texts, base, groups, least), "words")
        languages = docs.select(_language().alias("lang"), _lang_code(base & 0x7FFFFFFF)).distinct()
        if words.filter("clash").isEmpty() and languages.groupBy("lang_code").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no base tells all words apart")
    words = words.drop("clash")
    totals = words.filter("m = 0").groupBy("m", "lang_code", *CODES).agg(F.sum("f").alias("f"))
    frequent = words.filter("m = 1")
    tables, last, known = [], frequent, 1
    for lengths in ([2], [3], [*range(4, longest + 1)]):
        if not lengths or lengths[0] > longest:
            break
        bitmap = bitmap_of(last)
        last = stage(count_phrases(texts, base, lengths, bitmap, known, groups, least), "phrases")
        bitmap.unpersist()
        tables.append(last)
        known = lengths[-1]
    columns = ["m", "lang_code", *CODES, "f"]
    counts = totals.select(columns).union(frequent.select(columns))
    for t in tables:
        counts = counts.union(t.select(columns))
    counts = stage(counts, "counts")
    scored = stage(score(counts, -(-counts.count() // SHARD_ROWS) or 1, max(spark.sparkContext.defaultParallelism, groups // 4)), "scored")
    release(spark, [p for p in staged() if p not in others and ("/phrases-" in p or "/counts-" in p)])
    left = scored.join(inside_longer(scored), ["lang_code", *CODES], "left_anti")
    by_score = Window.partitionBy("lang_code").orderBy(F.desc("score"), F.desc("a"))
    left = stage(left.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top), "best")
    spelled = left.select("lang_code", *CODES, F.posexplode(F.filter(F.array(*CODES), lambda c: c != 0)).alias("at", "code"))
    names = frequent.select("lang_code", F.col("c1").alias("code"), "word")
    spelled = spelled.join(names, ["lang_code", "code"]).groupBy("lang_code", *CODES).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrases = left.join(spelled, ["lang_code", *CODES]).withColumn("phrase", F.concat_ws(" ", "words.word")).join(languages, "lang_code")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
