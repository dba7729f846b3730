"""Line dedup: fuzzy lines by rare word pairs and edit similarity.

A line is normalised to its lower-cased words without punctuation; a character of
a script without spaces is a word. Lines with the same words are one. Two lines are near if the edit similarity of their words
is at least ``SIMILAR``; near lines are linked, and of every connected group the
first line in document order stays.

Candidates are found without loss. An edit of a word changes at most two of a
line's pairs of adjacent words, so with pairs in one global order, rarest first,
two near lines share one of the first few (``prefix``) of each. How often a pair
occurs is read from a sketch over all documents; it decides the order, hence the
work, never the result. A shared pair that stays is moved by no more words than
edits are allowed before and behind it together, so pairs of lines whose word pair
lies elsewhere are dropped. An edit also changes at most two bits of the parities of
word counts in 256 classes; pairs of lines that differ in more bits than their
allowed edits can change are dropped before they are aligned.

A SimHash of 64 bits at a distance of 2 (``simhash``, ``DISTANCE``) found only a
part of these lines: a replaced word moves 8 bits in a line of 10 words.

Of a line as many of its rarest word pairs travel as its allowed edits can't all change:
an edit changes two only if they stand side by side (``needed``).

Lines, word pairs (16 bytes each) and candidates travel packed, by groups of their hash.
A group keeps word pairs that several lines share. Up to ``FEW`` lines of a word pair are
compared with each other; more are first compared with a few of them, the hubs, then,
after contraction, lines that share a word pair but not yet a connected group, so that
many variants of a line are not
expanded into all pairs and no link is lost. Lines that share a word pair, lie in
different groups and are not near are filtered pair by pair inside a task, in numpy:
time grows with the square of their number there, memory and rows do not.

Defined cases: lines of fewer than ``MIN_WORDS`` words are near no other, but go
as exact repeats; lines of fewer than ``MIN_CHARS`` characters in words, empty ones
too, always stay; null text stays null; a text that loses all its lines becomes empty, its
row stays; lines of rows that repeat id and text are one occurrence each row
keeps; a null id sorts first; columns of the input are passed on, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.components import components
from headway.llm.ngram_join import BLOCK, SLOTS, _level
from headway.llm.tables import NO_ID, arrow_schema, free_name, group_count, keyed, map_batches, stage, to_id
from headway.llm.words import SPACES, Slice, mix, slices, spans_hash
from headway.session import release, staged

MIN_WORDS = 4
MIN_CHARS = 3
DISTANCE = 2
SIMILAR = 0.8
#: Lines a task remembers to emit their word pairs once.
REMEMBERED = 100_000
#: Bytes of text worked on at once; small, so that the arrays of a slice stay near the processor.
SLICE = 400_000
#: Word pairs and lines a task holds before it packs them, and text bytes whose word pairs make a group.
HELD = 500_000
HELD_LINES = 50_000
GROUP_BYTES = 16_000_000
#: Lines of a word pair that others are compared with before contraction.
HUBS = 8
#: Lines of a word pair up to which all of them are compared with each other.
FEW = 4
#: Pairs of lines that are filtered at once.
CHUNK = 200_000
PARITIES = 4
#: Words of the longest lines whose prefixes are shortened by the places of their word pairs.
MEASURED = 256
#: Stands for a length or a place that does not fit, or a word pair that stands twice in its line.
ANY = 65535
LINE_BITS, LEVEL_BITS = 20, 6
_OTHER = 0xC2B2AE3D27D4EB4F

BREAKS = SPACES.copy()
BREAKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def line_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: row, number in its row, first word, end of its words."""
    nl = np.flatnonzero(s.data == 10)
    row_nl = np.searchsorted(s.bounds, nl, "right") - 1
    start = np.concatenate([s.bounds[:-1], nl + 1])
    row = np.concatenate([np.arange(s.n_rows), row_nl])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(s.n_rows))[row]
    end = np.append(start[1:], len(s.data))
    return row, number, np.searchsorted(s.start, start), np.searchsorted(s.start, end)


def simhash(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the words of each span; spans follow one another and are not empty."""
    out = np.empty(len(first), np.uint64)
    step = max(1, len(first) // max(1, len(code) // 50_000 + 1))
    for i in range(0, len(first), step):
        f, e = first[i : i + step], last[i : i + step]
        words = code[f[0] : e[-1]]
        bits = np.unpackbits(mix(words).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        votes = np.add.reduceat(bits, f - f[0], axis=0)
        out[i : i + step] = np.packbits(2 * votes > (e - f)[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def allowed(n):
    """Most edits that leave an edit similarity of ``SIMILAR`` when the longer line has n words."""
    return np.floor((1 - SIMILAR) * np.asarray(n) + 1e-9).astype(np.int64)


def prefix(n: np.ndarray) -> np.ndarray:
    """How many word pairs of a line of n words any near line, up to a quarter longer, must share one of."""
    return 1 + np.max([2 * allowed(n + more) - more for more in range(6)], axis=0)


def spans(s: Slice, words: int, chars: int = 0):
    """Of every line of enough words and characters: row, number in its row, its words one after another, bounds of the lines in them."""
    row, number, first, last = line_words(s)
    keep = last - first >= words
    if chars:
        begun = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
        size = np.concatenate([[0], np.cumsum(begun[s.end] - begun[s.start])])
        keep &= size[last] - size[first] >= chars
    row, number, first, last = row[keep], number[keep], first[keep], last[keep]
    # words of dropped lines lie between the spans: compact them away
    size = last - first
    bounds = np.concatenate([[0], np.cumsum(size)])
    return row, number, s.code[np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def parities(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits of each line: whether the number of its words in a class is odd."""
    bit = np.uint64(1) << (words & np.uint64(63))
    part = words >> np.uint64(6) & np.uint64(3)
    none = np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(part == i, bit, none), bounds[:-1]) for i in range(PARITIES)])


def word_pairs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, fingerprint) of every two adjacent words of a line."""
    line = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(line[1:] == line[:-1])
    return line[at], mix(words[at] * np.uint64(_OTHER) + words[at + 1])


@cache
def _lost() -> np.ndarray:
    """Most word pairs, of some, that edits allowed to a line can change: by its number of words and by how many edits can change two of them."""
    n, twos = np.arange(MEASURED + 1)[:, None, None], np.arange(allowed(MEASURED) + 1)[None, :, None]
    more = np.arange(MEASURED // 4 + 2)  # words that the other line is longer by; each is an edit that changes one pair only
    edits = allowed(n + more)
    return np.where(edits >= more, edits + np.minimum(edits - more, twos), 0).max(axis=2)


def needed(size: np.ndarray, keep: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many of its rarest word pairs a line needs, ``keep`` at most, so that a near line has one of them.

    ``size`` is the number of word pairs of each line, ``place`` their places in the global
    order, line by line. An edit changes two word pairs only if they stand side by side (or stand
    twice in the line), so pairs that lie apart are as many edits.
    """
    lost, measured = _lost(), size < MEASURED
    first = np.cumsum(size) - size
    spot = first + 2 * np.arange(len(size)) + 1  # with a gap between lines
    run = np.zeros(int(size.sum()) + 2 * len(size) + 1, np.int64)  # lengths of runs of places, at both their ends
    # no line needs fewer than these
    least = np.minimum(np.minimum(keep, size), allowed(size + 1) + 1)
    taken = np.repeat(np.where(measured, least, 0), size) > np.arange(len(place)) - np.repeat(first, size)
    of, at = np.repeat(np.arange(len(size)), size)[taken], place[taken]
    known = at != ANY
    there = np.zeros(len(run), bool)
    there[spot[of[known]] + at[known]] = True
    edge = np.flatnonzero(there[1:] != there[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    run[begin] = run[end - 1] = end - begin
    twos = np.bincount(of[~known], minlength=len(size))
    twos += np.bincount(np.searchsorted(spot, begin, "right") - 1, (end - begin) // 2, len(size)).astype(np.int64)
    keep = np.minimum(keep, size)
    enough = np.where(measured, least, keep)
    left = np.flatnonzero(measured)
    while len(left := left[lost[size[left] + 1, np.minimum(twos[left], lost.shape[1] - 1)] >= enough[left]]):
        left = left[enough[left] < keep[left]]
        at = place[first[left] + enough[left]]
        enough[left] += 1
        known = at != ANY
        twos[left[~known]] += 1
        own, of = (spot[left] + at)[known], left[known]
        before, behind = run[own - 1], run[own + 1]
        now = before + behind + 1
        run[own] = run[own - before] = run[own + behind] = now
        twos[of] += now // 2 - before // 2 - behind // 2
    return enough


def rarest(line: np.ndarray, code: np.ndarray, keep: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, value, place) of the word pairs of every line that are ``needed``, in the global order; place is ``ANY`` if the pair stands twice there.

    The order is by level and the upper bits of the fingerprint; pairs equal in both are one
    value, and the k-th of equal ones in a line counts as a value of its own.
    """
    out = []
    begin, n_lines = 0, int(line[-1]) + 1 if len(line) else 0
    for block in range(0, n_lines, 1 << LINE_BITS):
        end = int(np.searchsorted(line, block + (1 << LINE_BITS)))
        part, part_code = line[begin:end], code[begin:end]
        level = levels[(part_code & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
        bits = np.uint64(64 - LINE_BITS - LEVEL_BITS)
        key = ((part - block).astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (level << bits) | (part_code >> np.uint64(64) - bits)
        order = np.argsort(key)
        begins = runs(part)
        first = np.repeat(begins[:-1], np.diff(begins))
        key, of, at = key[order], part[order], np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        again = at - np.maximum.accumulate(np.where(new, at, 0))
        twice = ~new
        twice[:-1] |= ~new[1:]
        place = np.where(twice, ANY, np.minimum(order - first, ANY))  # lines keep their places when their pairs are sorted
        size = np.diff(begins)
        inside = at - first < np.repeat(needed(size, keep[of[begins[:-1]]], place), size)
        value = mix((key << np.uint64(LINE_BITS)) + mix(again.astype(np.uint64) * np.uint64(_OTHER)))
        out.append((of[inside], value[inside], place[inside]))
        begin = end
    if not out:
        return line, code, line
    return tuple(np.concatenate(c) for c in zip(*out))


#: A line: fingerprint of 128 bits of its words, its place, number of words, parities.
LINE = np.dtype([("h1", np.uint64), ("h2", np.uint64), ("key", np.int64), ("th", np.int64), ("line", np.int32), ("n", np.int32), ("parities", np.uint64, (PARITIES,))])
PLACE = np.dtype([("key", np.int64), ("th", np.int64), ("line", np.int32)])
READ = "part int, data binary, repeats binary"


def firsts(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first one of equal lines, by fingerprint; and the places of the others."""
    lines = lines[np.lexsort(tuple(lines[c] for c in ("line", "th", "key", "h2", "h1")))]
    begin = runs(lines["h1"], lines["h2"])
    first = np.repeat(lines[begin[:-1]], np.diff(begin))
    other = lines[np.any([lines[c] != first[c] for c in PLACE.names], axis=0)]
    other = other[runs(*[other[c] for c in ("h1", "h2", *PLACE.names)])[:-1]]
    places = np.empty(len(other), PLACE)
    for c in PLACE.names:
        places[c] = other[c]
    return lines[begin[:-1]], places


def part_of(h1: np.ndarray, n_groups: int) -> np.ndarray:
    return (h1 % np.uint64(n_groups)).astype(np.int64)


def by_group(group: np.ndarray, rows: np.ndarray, n_groups: int):
    """(group, bytes of its rows) of all groups that have any."""
    order = np.argsort(group, kind="stable")
    rows, ends = rows[order], np.cumsum(np.bincount(group, minlength=n_groups))
    for i in np.unique(group).tolist():
        yield i, rows[ends[i - 1] if i else 0 : ends[i]].tobytes()


def read_lines(texts: DataFrame, n_groups: int) -> DataFrame:
    """(part, data, repeats): packed lines with enough characters by group of their fingerprint, of equal ones in a task mostly the first, and places of the others; the task's counts of word pairs as parts below 0."""

    def flush(held):
        lines, places = firsts(np.concatenate(held))
        # any group will do for the places: one very common line is spread over all
        repeats = dict(by_group((mix(places["key"].view(np.uint64)) % np.uint64(n_groups)).astype(np.int64), places, n_groups))
        data = dict(by_group(part_of(lines["h1"], n_groups), lines, n_groups))
        part = sorted(data.keys() | repeats.keys())
        yield {"part": part, "data": [data.get(i, b"") for i in part], "repeats": [repeats.get(i, b"") for i in part]}

    def run(batches):
        counts, codes, held, n_lines, n_pairs = np.zeros(SLOTS, np.int64), [], [], 0, 0
        for b in batches:
            key, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in slices(b.column(2), BREAKS, lower=True, characters=True, size=SLICE):
                row, number, words, bounds = spans(s, 1, MIN_CHARS)
                if not len(row):
                    continue
                _, code = word_pairs(words, bounds)
                codes.append((code & np.uint64(SLOTS - 1)).astype(np.int32))
                n_pairs += len(code)
                if n_pairs > HELD:
                    counts += np.bincount(np.concatenate(codes), minlength=SLOTS)
                    codes, n_pairs = [], 0
                lines = np.empty(len(row), LINE)
                lines["key"], lines["th"], lines["line"], lines["n"] = key[s.offset + row], th[s.offset + row], number, np.diff(bounds)
                lines["h1"], lines["h2"] = spans_hash(words, bounds[:-1], bounds[1:]), spans_hash(words, bounds[:-1], bounds[1:], _OTHER)
                lines["parities"] = parities(words, bounds).T
                held.append(lines)
                n_lines += len(lines)
                if n_lines > HELD_LINES:
                    yield from flush(held)
                    held, n_lines = [], 0
        if held:
            yield from flush(held)
        if n_pairs:
            counts += np.bincount(np.concatenate(codes), minlength=SLOTS)
        for i in range(SLOTS // BLOCK):
            block = np.minimum(counts[i * BLOCK : (i + 1) * BLOCK], 2**32 - 1).astype(np.uint32)
            if block.any():
                yield {"part": [-1 - i], "data": [block.tobytes()], "repeats": [b""]}

    return map_batches(texts, run, READ)


def scan_lines(texts: DataFrame, n_groups: int) -> DataFrame:
    """(part, data, repeats): the distinct lines of every group as their first places, by fingerprint, and the places of the others; levels of the sketch as parts below 0; a staged table."""
    made = arrow_schema(READ)

    def gather(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        if part < 0:
            data, repeats = _level(sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in group.column("data"))), b""
        else:
            data, places = firsts(packed(group.column("data"), LINE))
            repeats = b"".join(x.as_py() for x in group.column("repeats")) + places.tobytes()
        return pa.Table.from_pydict({"part": [part], "data": [data.tobytes()], "repeats": [repeats]}, schema=made)

    return stage(read_lines(texts, n_groups).groupBy("part").applyInArrow(gather, READ), "lines")


def pair_levels(texts: DataFrame, scan: DataFrame | None = None) -> np.ndarray:
    """How often word pairs occur in the documents, as levels of a sketch; ``scan`` is what ``scan_lines`` made of them, if at hand."""
    scan = scan_lines(texts, group_count(texts, GROUP_BYTES)) if scan is None else scan
    levels = np.zeros(SLOTS, np.uint8)
    for r in scan.filter("part < 0").select("part", "data").collect():
        i = -1 - r["part"]
        levels[i * BLOCK : (i + 1) * BLOCK] = np.frombuffer(r["data"], np.uint8)
    return levels


#: A line's word pair in a group: upper half of the value, line, its number of words, place of the pair.
ENTRY = np.dtype([("value", np.uint32), ("h1", np.uint64), ("n", np.uint16), ("place", np.uint16)])


def packets(parts: list[tuple], n_groups: int):
    """Word pairs of lines by group of their value, a packet each."""
    value, h1, n, place = (np.concatenate(c) for c in zip(*parts))
    entries = np.empty(len(value), ENTRY)
    entries["value"], entries["h1"], entries["n"], entries["place"] = value >> np.uint64(32), h1, n, place
    for i, data in by_group(((value & np.uint64(0xFFFFFFFF)) % np.uint64(n_groups)).astype(np.int64), entries, n_groups):
        yield {"part": [i], "data": [data]}


def read_pairs(texts: DataFrame, levels, n_groups: int) -> DataFrame:
    """(part, data): the rarest word pairs of the lines in packets, of equal lines in a task mostly once."""

    def run(batches):
        done, parts, held = set(), [], 0
        for b in batches:
            for s in slices(b.column(2), BREAKS, lower=True, characters=True, size=SLICE):
                _, _, words, bounds = spans(s, MIN_WORDS)
                h1 = spans_hash(words, bounds[:-1], bounds[1:])
                fresh = np.zeros(len(h1), bool)
                for i, h in enumerate(h1.tolist()):
                    if h not in done:
                        done.add(h)
                        fresh[i] = True
                if len(done) > REMEMBERED:
                    done = set()
                n = np.diff(bounds)
                words, n, h1 = words[np.repeat(fresh, n)], n[fresh], h1[fresh]
                line, value, place = rarest(*word_pairs(words, np.concatenate([[0], np.cumsum(n)])), prefix(n), levels.value)
                parts.append((value, h1[line], np.minimum(n, ANY)[line].astype(np.uint16), place.astype(np.uint16)))
                held += len(line)
                if held > HELD:
                    yield from packets(parts, n_groups)
                    parts, held = [], 0
        if held:
            yield from packets(parts, n_groups)

    return map_batches(texts, run, "part int, data binary")


def may_be_near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lengths of two lines, and places of the word pair they share, allow them to be near."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    i, j = x["place"].astype(np.int64), y["place"].astype(np.int64)
    most = allowed(np.maximum(n, m))
    unknown = (n == ANY) | (m == ANY)
    before = np.where((i == ANY) | (j == ANY), 0, np.abs(i - j))
    behind = np.where((i == ANY) | (j == ANY), np.abs(n - m), np.abs((n - i) - (m - j)))
    return unknown | (before + behind <= most)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]]) if len(keys[0]) else np.zeros(1, np.int64)


def shared(entries: np.ndarray) -> np.ndarray:
    """The entries of values that several lines hold, each once, by value and line."""
    entries = entries[np.argsort(entries["value"])]
    size = np.diff(runs(entries["value"]))
    entries = entries[np.repeat(size, size) > 1]
    entries = entries[np.lexsort((entries["h1"], entries["value"]))]
    entries = entries[runs(entries["value"], entries["h1"])[:-1]]
    size = np.diff(runs(entries["value"]))
    return entries[np.repeat(size, size) > 1]


def distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines, smaller one first, each once."""
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    at = runs(x, y)[:-1]
    return x[at], y[at]


def star(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (hub, line): of each value, lines that may be near its first one, then of the others those that may be near the first of them, ``HUBS`` times."""
    found, left = [(np.zeros(0, np.uint64),) * 2], entries
    for _ in range(HUBS):
        begin = runs(left["value"])
        size = np.diff(begin)
        hub = np.repeat(begin[:-1], size)
        ok = may_be_near(left[hub], left)
        ok[begin[:-1]] = False
        found.append((left["h1"][hub[ok]], left["h1"][ok]))
        ok[begin[:-1]] = True
        left = left[~ok]
        if not len(left):
            break
    return distinct_pairs(*(np.concatenate(c) for c in zip(*found)))


def across(entries: np.ndarray, line: np.ndarray, component: np.ndarray, near=None) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among lines that share a value and lie in different components; ``line`` is sorted, other lines are alone. ``near``: a further condition on two arrays of lines."""
    of = entries["h1"].copy()
    alone = np.ones(len(of), bool)
    if len(line):
        at = np.minimum(np.searchsorted(line, of), len(line) - 1)
        alone = line[at] != of
        of[~alone] = component[at[~alone]]
    order = np.lexsort((of, alone, entries["value"]))
    entries, of, alone = entries[order], of[order], alone[order]
    same = runs(entries["value"], of, alone)
    ends = np.repeat(same[1:], np.diff(same))  # the first entry of another component
    values = runs(entries["value"])
    until = np.repeat(values[1:], np.diff(values))
    total = np.concatenate([[0], np.cumsum(until - ends)])
    found = [(np.zeros(0, np.uint64),) * 2]
    for low in range(0, int(total[-1]), CHUNK):
        k = np.arange(low, min(low + CHUNK, int(total[-1])))
        x = np.searchsorted(total, k, "right") - 1
        y = ends[x] + k - total[x]
        ok = may_be_near(entries[x], entries[y])
        x, y = distinct_pairs(entries["h1"][x[ok]], entries["h1"][y[ok]])
        if near is not None and len(x):
            ok = near(x, y)
            x, y = x[ok], y[ok]
        found.append((x, y))
    return distinct_pairs(*(np.concatenate(c) for c in zip(*found)))


def packed(data, kind: np.dtype = ENTRY) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in data), kind)


def looked_up(lines: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``h1``, index in ``lines``, which are sorted) of equal fingerprints; two lines may have one."""
    low, high = (np.searchsorted(lines["h1"], h1, side) for side in ("left", "right"))
    at = np.repeat(np.arange(len(h1)), high - low)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[at]


def within(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lengths and parities of lines allow them to be near: a word replaced changes two bits at most, one dropped or added one."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    most, longer = allowed(np.maximum(n, m)), np.abs(n - m)
    bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (longer <= most) & (bits <= 2 * most - longer)


def sent(x: np.ndarray, y: np.ndarray, n_groups: int) -> list[tuple[int, bytes]]:
    """Pairs of lines, packed by the group of the first."""
    return list(by_group(part_of(x, n_groups), np.stack([x, y], axis=1), n_groups)) if len(x) else []


def edit_distance(a: np.ndarray, b: np.ndarray, most: int | None = None) -> int:
    """Levenshtein distance of two sequences; beyond ``most``, some number above it.

    A column of the table is two bit vectors, where it rises and where it falls, so an item
    of the longer sequence costs a few operations on whole numbers.
    """
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = int(differ[0]) if len(differ) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    n, left = len(a), len(b)
    full, last = (1 << n) - 1, 1 << n - 1
    up, down, distance = full, 0, n
    most = n + left if most is None else most
    for y in b.tolist():
        same = at.get(y, 0)
        flat = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(flat | up)), up & flat
        left -= 1
        if rise & last:
            distance += 1
            if distance - left > most:
                return distance - left
        elif fall & last:
            distance -= 1
        rise = rise << 1 | 1
        up = (fall << 1 | ~(flat | rise)) & full
        down = rise & flat
    return distance


def cut_lines(texts: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, text) of the wanted lines of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    number = wanted.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(wanted).to_numpy())
    breaks = np.flatnonzero(raw[off[0] : off[-1]] == 10) + off[0]
    before = np.searchsorted(breaks, off)
    breaks = np.append(breaks, 0)  # stands for no break; not used
    nth = before[row] + number
    start = np.where(number > 0, breaks[np.maximum(nth - 1, 0)] + 1, off[row])
    end = np.where(nth < before[row + 1], breaks[np.minimum(nth, len(breaks) - 1)], off[row + 1])
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
    return row, number, pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links (a, b: numbers of lines) among ``pairs``, a staged table, whose edit similarity is high enough; a staged table."""
    before = staged()
    asked = pairs.selectExpr("pk AS key", "pt AS th", "pl AS line", "x AS id").union(pairs.selectExpr("qk AS key", "qt AS th", "ql AS line", "y AS id")).distinct()
    wanted = asked.groupBy("key", "th").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))  # at most the document's lines
    wanted = wanted.select("key", "th", F.col("wanted.line").alias("wanted"), F.col("wanted.id").alias("ids"))

    def codes(batches):
        done = set()  # rows that repeat id and text
        for b in batches:
            docs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            new = [d not in done and not done.add(d) for d in docs]
            b = b if all(new) else b.filter(pa.array(new))
            size = np.cumsum(pa.compute.binary_length(b.column(2)).to_numpy().astype(np.int64))
            at = 0
            while at < len(size):  # indices of bytes are eight times the text: a few rows at once
                to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE)))
                _, _, cut = cut_lines(b.column(2)[at:to], b.column(3)[at:to])
                ids = b.column(4)[at:to].flatten().to_numpy()
                for s in slices(cut, BREAKS, lower=True, characters=True, size=SLICE):
                    inside = slice(s.offset, s.offset + s.n_rows)
                    bounds = pa.py_buffer((8 * s.first).astype(np.int32))
                    words = pa.Array.from_buffers(pa.binary(), s.n_rows, [None, bounds, pa.py_buffer(np.ascontiguousarray(s.code))])
                    yield {"id": ids[inside], "words": words}
                at = to

    rows = texts.join(wanted.hint("shuffle_hash"), ["key", "th"]).select("key", "th", "text", "wanted", "ids")
    words = stage(map_batches(rows, codes, "id long, words binary"), "line-words")
    p = words.select(F.col("id").alias("x"), F.col("words").alias("pw"))
    q = words.select(F.col("id").alias("y"), F.col("words").alias("qw"))
    both = pairs.select("x", "y").join(p, "x").join(q, "y")

    def near(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                most = int(allowed(max(len(x), len(y))))
                if abs(len(x) - len(y)) <= most and edit_distance(x, y, most) <= most:
                    keep.append(i)
            yield {name: b.column(i).take(pa.array(keep, pa.int64())) for i, name in enumerate("ab")}

    found = map_batches(both.select("x", "y", "pw", "qw"), near, "a long, b long")
    used = [x for x in staged() if x not in before]
    links = stage(found, "line-links")
    release(texts.sparkSession, used)
    return links


#: A line's number is its group and where it stands there.
STANDS = 32
#: A pair of lines on its way: number and all of the first, the fingerprint of the second.
HALF = np.dtype([("y", np.uint64), ("id", np.int64), ("x", LINE)])
#: What a group gets to know of a line that it asks for.
KNOWN = np.dtype([("h1", np.uint64), ("component", np.uint64), ("alone", bool), ("sure", bool), ("n", np.int32), ("parities", np.uint64, (PARITIES,))])
PAIRS = "pk long, pt long, pl int, qk long, qt long, ql int, x long, y long"


def places(found: DataFrame, scan: DataFrame, n_groups: int) -> DataFrame:
    """First places (p, q) and numbers (x, y) of the lines of candidates (to, pairs) that lengths and parities allow; a staged table."""
    form = "to int, pairs binary"
    half, whole = arrow_schema(form), arrow_schema(PAIRS)
    lines = scan.filter("part >= 0").select("part", "data").groupBy("part")

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = distinct_pairs(*packed(left.column("pairs"), np.dtype((np.uint64, 2))).T) if len(left) else (np.zeros(0, np.uint64),) * 2
        known = packed(right.column("data"), LINE)
        at, i = looked_up(known, x)
        pairs = np.empty(len(at), HALF)
        pairs["y"], pairs["x"] = y[at], known[i]
        pairs["id"] = (right.column("part")[0].as_py() << STANDS) + i if len(at) else 0
        to = list(by_group(part_of(pairs["y"], n_groups), pairs, n_groups)) if len(at) else []
        return pa.Table.from_pydict({"to": [t for t, _ in to], "pairs": [d for _, d in to]}, schema=half)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = packed(left.column("pairs"), HALF) if len(left) else np.zeros(0, HALF)
        known = packed(right.column("data"), LINE)
        at, i = looked_up(known, pairs["y"])
        x, y, one = pairs["x"][at], known[i], pairs["id"][at]
        two = i + (right.column("part")[0].as_py() << STANDS) if len(at) else i
        ok = within(x["n"], y["n"], x["parities"], y["parities"])
        x, y = x[ok], y[ok]
        names = zip(("pk", "pt", "pl", "qk", "qt", "ql"), (*[x[c] for c in PLACE.names], *[y[c] for c in PLACE.names]))
        return pa.Table.from_pydict(dict(names) | {"x": one[ok], "y": two[ok]}, schema=whole)

    ones = found.select("to", "pairs").groupBy("to").cogroup(lines).applyInArrow(first, form)
    return stage(ones.groupBy("to").cogroup(lines).applyInArrow(second, PAIRS), "line-pairs")


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) with further links between lines; only what they join is labelled anew."""
    for x in ("a", "b"):
        of = labels.select(F.col("node").alias(x), F.col("component").alias("of"))
        links = links.join(of, x, "left").withColumn(x, F.coalesce("of", x)).drop("of")
    joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("root"))
    alone = joined.select(F.col("component").alias("node"), "component").join(labels.select("node"), "node", "left_anti")
    return stage(labels.union(alone).join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")


def groups(texts: DataFrame, scan: DataFrame, n_groups: int) -> DataFrame:
    """(node, component): numbers of lines by connected group, of all groups of more than one distinct line."""
    levels = texts.sparkSession.sparkContext.broadcast(pair_levels(texts, scan))
    form, told, crossed = "part int, data binary, to int, pairs binary, ask binary", "part int, known binary", "to int, pairs binary"
    made, answered, crossing = arrow_schema(form), arrow_schema(told), arrow_schema(crossed)

    def hubs(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        entries = shared(packed(group.column("data")))
        size = np.diff(runs(entries["value"]))
        few = np.repeat(size, size) <= FEW
        many = entries[~few]
        none = np.zeros(0, np.uint64)
        x, y = distinct_pairs(*(np.concatenate(c) for c in zip(across(entries[few], none, none), star(many))))
        rows = [(None, to, pairs, None) for to, pairs in sent(x, y, n_groups)]
        if len(many):
            asked = np.unique(many["h1"])
            rows += [(many.tobytes(), None, None, None)] + [(None, to, None, ask) for to, ask in by_group(part_of(asked, n_groups), asked, n_groups)]
        columns = dict(zip(("data", "to", "pairs", "ask"), zip(*rows))) if rows else {k: [] for k in ("data", "to", "pairs", "ask")}
        return pa.Table.from_pydict({"part": [part] * len(rows)} | columns, schema=made)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        lines = packed((x for x in right.column("data") if x.is_valid), LINE)
        node, component = (right.column(k).drop_null().to_numpy().astype(np.int64) for k in ("node", "component"))
        linked = np.full(len(lines), -1, np.int64)
        linked[node & ((1 << STANDS) - 1)] = component
        out = []
        for part, ask in zip(left.column("part").to_pylist(), left.column("ask")):
            asked = np.frombuffer(ask.as_py(), np.uint64)
            at, i = looked_up(lines, asked)
            known = np.zeros(len(asked), KNOWN)
            known["h1"], known["n"][at], known["parities"][at] = asked, lines["n"][i], lines["parities"][i]
            # of two lines with one h1 none is known: more is compared, nothing is lost
            known["sure"] = np.bincount(at, minlength=len(asked)) == 1
            known["alone"], known["component"] = True, asked
            alone = ~known["sure"][at] | (linked[i] < 0)
            known["alone"][at[~alone]], known["component"][at[~alone]] = False, linked[i[~alone]].astype(np.uint64)
            out.append((part, known.tobytes()))
        return pa.Table.from_pydict({"part": [p for p, _ in out], "known": [k for _, k in out]}, schema=answered)

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        known = packed(right.column("known"), KNOWN)
        known = known[np.argsort(known["h1"])]

        def near(x, y):
            a, b = known[np.searchsorted(known["h1"], x)], known[np.searchsorted(known["h1"], y)]
            return ~(a["sure"] & b["sure"]) | within(a["n"], b["n"], a["parities"], b["parities"])

        of = known[~known["alone"]]
        to = sent(*across(packed(left.column("data")), of["h1"], of["component"], near), n_groups)
        return pa.Table.from_pydict({"to": [t for t, _ in to], "pairs": [p for _, p in to]}, schema=crossing)

    found = stage(read_pairs(texts, levels, n_groups).groupBy("part").applyInArrow(hubs, form), "word-pairs")
    pairs = places(found.filter("pairs IS NOT NULL"), scan, n_groups)
    links = verified(texts, pairs)
    labels = components(links)
    asked = found.filter("ask IS NOT NULL").select("part", F.col("to").alias("of"), "ask")
    if asked.isEmpty():
        return labels
    none = F.lit(None)
    known = labels.select(F.shiftright("node", STANDS).cast("int").alias("of"), none.cast("binary").alias("data"), "node", "component")
    lines = scan.filter("part >= 0").select(F.col("part").alias("of"), "data", none.cast("long").alias("node"), none.cast("long").alias("component"))
    answers = asked.groupBy("of").cogroup(lines.union(known).groupBy("of")).applyInArrow(answer, told)
    data = found.filter("data IS NOT NULL").select("part", "data")
    more = stage(data.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(rest, crossed), "line-rest")
    if more.isEmpty():
        return labels
    return grown(labels, verified(texts, places(more, scan, n_groups)))


def placed(labels: DataFrame, scan: DataFrame) -> DataFrame:
    """(component, key, th, line): the first places of lines (node, component)."""
    form = "component long, key long, th long, line int"
    made = arrow_schema(form)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        node = left.column("node").to_numpy().astype(np.int64)
        lines = packed(right.column("data"), LINE)[node & ((1 << STANDS) - 1)] if len(node) else np.zeros(0, LINE)
        return pa.Table.from_pydict({"component": left.column("component")} | {c: lines[c] for c in PLACE.names}, schema=made)

    numbered = labels.select(F.shiftright("node", STANDS).cast("int").alias("of"), "node", "component")
    lines = scan.filter("part >= 0").select(F.col("part").alias("of"), "data")
    return stage(numbered.groupBy("of").cogroup(lines.groupBy("of")).applyInArrow(place, form), "line-places")


def repeated(docs: DataFrame) -> DataFrame:
    """(key, th, removed): line numbers that repeat an earlier line or are near one; a staged table, the ones before it are deleted."""
    before = staged()
    texts = keyed(docs)
    n_groups = group_count(texts, GROUP_BYTES)
    scan = scan_lines(texts, n_groups)
    labels = groups(texts, scan, n_groups)

    def unpacked(batches):
        for b in batches:
            for x in b.column(0):
                places = np.frombuffer(x.as_py(), PLACE)
                yield {c: places[c] for c in PLACE.names}

    gone = map_batches(scan.filter("part >= 0").select("repeats"), unpacked, "key long, th long, line int")
    near = placed(labels, scan)
    place = F.struct("key", "th", "line")
    stays = near.groupBy("component").agg(F.min(place).alias("stays"))
    gone = gone.union(near.join(stays, "component").filter(place != F.col("stays")).select("key", "th", "line"))
    used = [p for p in staged() if p not in before]
    removed = stage(gone.groupBy("key", "th").agg(F.collect_set("line").alias("removed")), "removed-lines")
    release(docs.sparkSession, used)
    return removed


def dedup(docs: DataFrame) -> DataFrame:
    """The input with repeated lines taken out of ``text``; ``n_chars`` follows where there is one. Other columns as they are."""
    removed = repeated(docs)
    key, th, gone = (free_name(docs, f"{c}_of_line") for c in ("key", "th", "removed"))
    removed = removed.select(F.col("key").alias(key), F.col("th").alias(th), F.col("removed").alias(gone))
    marked = docs.withColumns(
        {key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    )
    joined = marked.join(removed.hint("shuffle_hash"), [key, th], "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and the SHA-256 of what is left of the text (null: empty)."""
    removed = repeated(docs)
    joined = keyed(docs).join(removed.hint("shuffle_hash"), ["key", "th"], "left")
    lines = F.split("text", "\n", -1)
    n = F.when(F.col("text") == "", 0).otherwise(F.size(lines))
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    return joined.select(
        to_id(), n.cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
