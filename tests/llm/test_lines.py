"""Candidates of near lines: filters lose nothing, word pairs of one line stay behind."""

import random

import numpy as np
import pyarrow as pa

from headway.llm import lines


def read(texts):
    s = next(lines.slices(pa.array(texts), lines.BREAKS, lower=True, characters=True))
    _, _, words, bounds = lines.spans(s, lines.MIN_WORDS)
    return words, bounds, lines.spans_hash(words, bounds[:-1], bounds[1:])


def entries_of(texts, n_groups):
    words, bounds, h1 = read(texts)
    n = np.diff(bounds)
    code = lines.word_pairs(words, bounds)
    levels = np.random.default_rng(5).integers(0, 20, lines.SLOTS).astype(np.uint8)
    line, value, place = lines.rarest(*code, lines.prefix(n), levels)
    rows = lines.packets([(value, h1[line], n[line].astype(np.uint16), place.astype(np.uint16))], n_groups)
    return words, bounds, h1, {r["part"][0]: lines.packed(pa.array(r["data"], pa.binary())) for r in rows}


def variants(seed):
    """Lines of few different words, so that pairs repeat inside a line, and copies with words replaced, dropped or added."""
    r, made = random.Random(seed), []
    for _ in range(60):
        w = [f"w{r.randrange(30)}" for _ in range(r.choice((4, 5, 9, 10, 20, 45)))]
        made.append(w)
        for _ in range(3):
            e = list(w)
            for _ in range(r.randrange(1, 2 + len(w) // 5)):
                at = r.randrange(len(e))
                e[at : at + r.randrange(2)] = [f"w{r.randrange(30)}"] * r.randrange(2)
            made.append(e)
    return list(dict.fromkeys(" ".join(w) for w in made if len(w) >= 4))


def near_pairs(words, bounds, h1):
    spans = [words[a:b] for a, b in zip(bounds, bounds[1:])]
    for j in range(len(spans)):
        for i in range(j):
            if lines.edit_distance(spans[i], spans[j]) <= lines.allowed(max(len(spans[i]), len(spans[j]))):
                yield tuple(sorted((int(h1[i]), int(h1[j]))))


def test_all_near_lines_are_candidates():
    words, bounds, h1, groups = entries_of(variants(3), 5)
    near, found = set(near_pairs(words, bounds, h1)), set()
    for entries in groups.values():
        x, y = lines.across(lines.shared(entries), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        found |= set(zip(x.tolist(), y.tolist()))
    everything = len(h1) * (len(h1) - 1) // 2
    assert len(near) > 100 and near <= found and len(found) < everything / 4


def test_lines_of_one_component_are_not_paired():
    _, _, h1, groups = entries_of(variants(4), 3)
    known = np.sort(h1)
    for entries in groups.values():
        assert not len(lines.across(lines.shared(entries), known, np.ones(len(known), np.uint64))[0])


def test_word_pairs_of_one_line_stay_behind():
    same = " ".join(f"s{i}" for i in range(20))
    texts = [" ".join(f"a{i}x{k}" for i in range(20)) for k in range(50)] + [same, f"{same} more", same]
    _, _, h1, groups = entries_of(texts, 4)
    kept = np.concatenate([lines.shared(e) for e in groups.values()])
    assert set(kept["h1"].tolist()) == {int(h1[50]), int(h1[51])}
    pairs = [lines.star(lines.shared(e)) for e in groups.values()]
    assert {(a, b) for x, y in pairs for a, b in zip(x.tolist(), y.tolist())} == {tuple(sorted((int(h1[50]), int(h1[51]))))}
    assert lines.ENTRY.itemsize == 16


def test_cut_lines():
    texts = ["a\nbc\n\nd", "", "\n", None, "no break", "x\ny"]
    wanted = [[3, 0, 2, 1], [0], [1, 0], [0], [0], [1]]
    row, number, cut = lines.cut_lines(pa.array(texts)[0:6], pa.array(wanted, pa.list_(pa.int32())))
    got = [(int(i), int(k), t) for i, k, t in zip(row, number, cut.to_pylist())]
    assert got == [(i, k, (texts[i] or "").split("\n")[k]) for i, ks in enumerate(wanted) for k in ks]
    row, number, cut = lines.cut_lines(pa.array(texts)[4:6], pa.array(wanted, pa.list_(pa.int32()))[4:6])
    assert cut.to_pylist() == ["no break", "y"]


def test_edit_distance_up_to_a_limit():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        for most in range(6):
            assert (lines.edit_distance(np.array(a), np.array(b), most) <= most) == (row[-1] <= most)


def test_word_pairs_that_lie_apart_make_short_prefixes():
    words, bounds, h1 = read(variants(7) + [" ".join(f"z{i}" for i in range(60))])
    n = np.diff(bounds)
    levels = np.random.default_rng(9).integers(0, 20, lines.SLOTS).astype(np.uint8)
    line, value, _ = lines.rarest(*lines.word_pairs(words, bounds), lines.prefix(n), levels)
    kept = np.bincount(line, minlength=len(n))
    assert (kept <= lines.prefix(n)).all() and (kept > lines.allowed(n)).all() and kept[-1] < lines.prefix(n)[-1]
    values = {int(h): set() for h in h1}
    for i, v in zip(line, value):
        values[int(h1[i])].add(int(v))
    near = list(near_pairs(words, bounds, h1))
    assert len(near) > 100 and all(values[a] & values[b] for a, b in near)


def test_neighbouring_word_pairs_count_as_one_edit():
    # two edits of ten words change four pairs that stand side by side two by two, but only two that lie apart
    size, keep = np.array([9, 9]), np.array([5, 5])
    apart, beside = np.array([0, 2, 4, 6, 8, 1, 3, 5, 7]), np.array([0, 1, 4, 5, 7, 2, 3, 6, 8])
    kept = lines.needed(size, keep, np.concatenate([apart, beside]))
    assert kept.tolist() == [3, 5]
    twice = np.full(9, lines.ANY)
    assert lines.needed(size[:1], keep[:1], twice).tolist() == [5]


def removed_by_brute_force(near, n):
    low = list(range(n))
    for _ in range(n):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    return {i for i, x in enumerate(low) if x != i}


def test_word_pairs_of_many_lines(spark, monkeypatch):
    """Hubs first, then lines of different groups only; the result is that of all pairs."""
    texts = variants(11)[:150]
    words, bounds, h1 = read(texts)
    at = {int(h): i for i, h in enumerate(h1)}
    near = [(at[a], at[b]) for a, b in near_pairs(words, bounds, h1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lines, "FEW", 0)
    monkeypatch.setattr(lines, "HUBS", 1)
    got = {r["doc_id"] for r in lines.report(df).collect() if r["n_removed"]}
    assert len(near) > 60 and got == removed_by_brute_force(near, len(texts))


def test_lines_travel_packed(spark):
    """Tasks hand on packets, not a row per line; equal lines of a task only once."""
    text = "\n".join(["one line of many copies", *(f"line {i} of its own words" for i in range(200))] * 3)
    df = lines.keyed(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").coalesce(1))
    rows = lines.read_lines(df, 5).filter("part >= 0").collect()
    assert len(rows) == 5 and sum(len(r["data"]) for r in rows) == 201 * lines.LINE.itemsize
    assert sum(len(r["repeats"]) for r in rows) == (60 - 1) * 201 * lines.PLACE.itemsize
    scan = lines.scan_lines(df, 5).filter("part >= 0").collect()
    first = np.concatenate([lines.packed(lines.pa.array([r["data"]]), lines.LINE) for r in scan])
    assert len(scan) == 5 and set(first["key"]) == {0} and sorted(first["line"].tolist()) == list(range(201))


def test_further_links_join_groups(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (7, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(7, 2), (3, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in lines.grown(labels, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 7: 1, 3: 3, 8: 3, 9: 3}
