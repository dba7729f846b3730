"""Benchmark passages in scripts without spaces, all alignments by hand, and stages on awkward columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import decontaminate, lines
from headway.llm.tables import free_name

HAN = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘成歲律呂調陽雲騰致雨露結為霜金生麗水玉出崑岡"
THAI = "กขคงจฉชซญดตถทธนบปผพฟภมยรลวศสหฬอฮ"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def changed(text, places):
    return "".join("龍" if i in places else c for i, c in enumerate(text))


@pytest.mark.parametrize("item", [HAN, THAI * 2])
def test_items_in_scripts_without_spaces(spark, item):
    r = random.Random(1)
    other = "".join(r.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(300))
    rows = [(1, item), (2, other[:120] + item + other[120:]), (3, other[:50] + changed(item, {9}) + other), (4, changed(item, {5, 30}) + "。" + other), (5, other), (6, item[::-1])]
    bench = spark.createDataFrame([(7, item), (8, "unrelated words of an item in a spaced script")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert set(got) == {(i, 7) for i in (1, 2, 3, 4)} and got[1, 7] == got[2, 7] == 1.0 and got[3, 7] > got[4, 7] > 0.8


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_all_pairs_by_hand(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = {i: [r.choice(words) for _ in range(r.choice([6, 25, 60]))] for i in range(8)}
    rows = []
    for d in range(60):
        text = [r.choice(words) for _ in range(r.randrange(0, 120))]
        if d % 3:
            copy = list(items[r.randrange(8)])
            for _ in range(r.randrange(0, len(copy) // 3 + 1)):
                at, kind = r.randrange(len(copy)), r.randrange(3)
                copy[at : at + (kind != 1)] = [] if kind == 0 else [r.choice(words)]
            cut = r.randrange(len(text) + 1)
            text[cut:cut] = copy[: r.randrange(len(copy) // 3, len(copy) + 1)]
        rows.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.matches(frame(spark, rows), bench).collect()}
    runs = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {(d, i): s / (2 * len(w)) for d, text in rows for i, w in items.items() if (s := smith_waterman(w, text.split())) >= len(w)}
    # a copy that keeps no three words in a row has no seed
    seeded = {(d, i): s for (d, i), s in want.items() if runs(items[i]) & runs(dict(rows)[d].split())}
    assert len(seeded) > 20 and len(want) - len(seeded) <= 1 and got == pytest.approx(seeded)


def test_an_item_over_and_over_in_a_long_text(spark, monkeypatch):
    item = " ".join(f"v{i}" for i in range(40))
    rows = [(1, " ".join([item] * 2000)), (2, "x " * 50_000 + item), (3, "y" * 1_000_000), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert got == {1: 1.0, 2: 1.0}


def test_batches_of_stretches_are_bounded():
    r = np.random.default_rng(3)
    item, size = r.integers(0, 5, 500), r.integers(1, 400_000, 500)
    seen = []
    for at in decontaminate._by_item(item, size):
        assert len(set(item[at])) == 1 and (len(at) == 1 or len(at) * size[at].max() <= decontaminate.CELLS)
        seen += at.tolist()
    assert sorted(seen) == list(range(500))


CLASH = ["key", "th", "found", "gone", "kept", "key_of_line", "_KEY_OF_LINE", "removed_of_line", "id_of_row", "own_of_row", "__key", "__id"]


def test_columns_of_any_name_pass_through(spark):
    import corpus_pipeline as p

    text = "one of the lines that stand in two documents of this test"
    rows = [(i, f"{text}\nand a line of its own {i} with more words", "en", *CLASH) for i in range(4)]
    names = ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {names}")
    bench = spark.createDataFrame([(1, "nothing of the kind stands in any of them at all")], "item_id long, text string")
    for out in (lines.dedup(docs), decontaminate.clean(docs, bench), p.language(spark, docs, ""), p.near_duplicates(spark, docs, "")):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all([r[c] for c in CLASH] == CLASH for r in got)
    assert free_name(docs, "Key") == "_Key" and free_name(docs, "none") == "none"


def test_nothing_goes_where_no_language_is_known(spark):
    import corpus_pipeline as p

    docs = frame(spark, [(1, "a text"), (2, None), (3, "12")]).withColumn("lang", F.lit(None).cast("string"))
    assert p.language(spark, docs, "").count() == 3
