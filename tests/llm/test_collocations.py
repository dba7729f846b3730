"""Phrase collocations and their automata against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from headway.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, m int, f long, word string, part long, lang_code long"


def sequences(n, width, seed, labels=6):
    r = np.random.default_rng(seed)
    return [r.integers(0, labels, n).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) for _ in range(width)]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_automaton_counts(width):
    columns = sequences(500, width, width)
    t, at = co.Transducer.build(columns, np.ones(500, np.int64))
    want = Counter(zip(*[c.tolist() for c in columns]))
    got = dict(zip(zip(*[c.tolist() for c in t.columns()]), t.weight.tolist()))
    assert got == dict(want) and [tuple(c[i] for c in columns) for i in at] == sorted(want)
    back, end = co.Transducer.unpack(t.pack() + b"more")
    assert [c.tolist() for c in back.columns()] == [c.tolist() for c in t.columns()] and back.weight.tolist() == t.weight.tolist()
    assert end == len(t.pack())


def test_automaton_union_and_lookup():
    a, b = sequences(300, 3, 1), sequences(200, 3, 2)
    t = co.Transducer.union([co.Transducer.build(x, np.ones(len(x[0]), np.int64))[0] for x in (a, b)])
    want = Counter(zip(*[c.tolist() for c in a])) + Counter(zip(*[c.tolist() for c in b]))
    asked = sequences(400, 3, 3, labels=9)
    assert t.weights(asked).tolist() == [want.get(k, 0) for k in zip(*[c.tolist() for c in asked])]
    none = co.Transducer.build([c[:0] for c in a], np.zeros(0, np.int64))[0]
    assert none.weights(asked).tolist() == [0] * 400
    assert len(t.label[0]) < len(t.label[1]) < len(t.label[2]), "prefixes are shared"


def by_hand(rows, least, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in frequent.items():
        if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 100 * a for (other, q), b in frequent.items() if other == lang):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top], 1))  # noqa: E741


def corpus(n, seed):
    r = random.Random(seed)
    words = ["The", "of", "été", "xÄ", "a-b", "zeta", "x1", "漢字", "end"]
    marks = [" "] * 8 + ["\t", ". ", ",", "\n", " ; ", "\x0b", "?!", " "]
    texts = ["".join(r.choice(words[: r.randint(2, 9)]) + r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(n)]
    rows = [(t, r.choice(["en", "de", None])) for t in texts]
    return rows + [(None, "en"), ("", "fr"), (" \t\n", None), (texts[0], "en"), (texts[0], "en"), ("same same same same same same", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, 1, 2, "w", 3, 4) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("least,top", [(3, 1000), (12, 7)])
def test_phrases_against_counting(spark, least, top):
    rows = corpus(60, least)
    got = sorted(tuple(r) for r in co.mine(frame(spark, rows), least=least, top=top).collect())
    assert got == by_hand(rows, least, top)


def test_products_beyond_64_bits_and_long_texts(spark):
    text = "go on " * 60_000 + "x" * 1_000_000 + " go on."
    rows = [(text, "en"), ("Go on, go on", "en")]
    got = [tuple(r) for r in co.mine(frame(spark, rows), longest=2).collect()]
    words, pairs, turns = 2 * 60_000 + 2 + 1 + 4, 60_000 + 3, 60_000 - 1
    assert got == [("en", 1, "go on", pairs, pairs, pairs, words, 1000 * words // pairs), ("en", 2, "on go", turns, pairs, pairs, words, 1000 * turns * words // pairs**2)]


def test_shards_and_ranges_do_not_change_counts(spark):
    rows = corpus(40, 5)
    want = by_hand(rows, 2, 500)
    got = sorted(tuple(r) for r in co.mine(frame(spark, rows).repartition(40), least=2, top=500).collect())
    assert got == want


def test_clash_of_fingerprints_is_seen(spark):
    docs = frame(spark, [("ab ba ab", "en"), ("cd", "en")])
    texts = docs.select(co._lang_code(1), "text")
    # with base 1 a fingerprint is a sum over letters, so that anagrams meet
    assert co.count_words(texts, 1, 4, 1).filter("clash").count() > 0
    assert co.count_words(texts, co.BASES[0], 4, 1).filter("clash").count() == 0


def test_empty(spark):
    out = co.mine(frame(spark, []))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
