"""The quality classifier: features and updates by hand, held-out accuracy, awkward input."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headway.llm import classifier as cl
from headway.llm.tables import documents, table
from headway.llm.words import slices

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, label int, at int, x int, score double, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 0.5, 4) for i, t in rows], SCHEMA).repartition(3)


def scores(df):
    return {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in df.collect()}


def by_row(texts):
    out = {}
    for s in slices(pa.array(texts, pa.string()), lower=True):
        row, at, x = cl.features(s)
        for r, a, v in zip((row + s.offset).tolist(), at.tolist(), x.tolist()):
            out.setdefault(r, {})[a] = v
    return out


def test_features_are_counts_of_words_and_pairs():
    texts = ["Été été ÉTÉ, x1!!", None, "", " \t", "one two three", "one\ntwo  three", "one two three four " * 30_000]
    got = by_row(texts)
    assert sorted(got) == [0, 4, 5, 6] and got[4] == got[5]
    # three words and two pairs, once each
    assert len(got[4]) == 5 and all(math.isclose(v, 1 / math.sqrt(5)) for v in got[4].values())
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[0]))
    pairs = list(zip(words, words[1:]))
    repeats = sum(a == b for a, b in pairs), sum(a == b for a, b in zip(words, words[2:]))
    distinct = len(set(words)) + len(set(pairs)) + sum(n > 0 for n in repeats)
    assert len(got[0]) == distinct and math.isclose(sum(v * v for v in got[0].values()), 1)
    # four words, four pairs (one over the turn), and nothing else in a long text
    assert len(got[6]) == 8


def test_updates_follow_the_formula():
    rng = np.random.default_rng(3)
    leader = cl.Leader(alpha=0.3, beta=1.0, l1=0.2, l2=0.1)
    z, n = np.zeros(cl.SIZE + 1), np.zeros(cl.SIZE + 1)
    for _ in range(50):
        at, x, y = rng.choice(20, 5, replace=False), rng.random(5), int(rng.integers(0, 2))
        w = [0.0 if abs(z[i]) <= 0.2 else -(z[i] - math.copysign(0.2, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 0.1) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, a, b in zip(at, w, x):
            g = 2.0 * (p - y) * b
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * a
            n[i] += g * g
        leader.update(at, x, y, 2.0)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)
    assert (leader.weights() == 0).sum() >= cl.SIZE - 20


@pytest.fixture(scope="module")
def tables(spark):
    return documents(spark, SF), table(spark, SF, "labels")


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = cl.classify(docs, labels).filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    right = sum(r["quality"] == r["predicted"] for r in out)
    bad = [r for r in out if r["quality"] == 0]
    assert len(out) > 80 and right / len(out) >= 0.97
    assert sum(r["predicted"] == 0 for r in bad) / len(bad) >= 0.8


def test_labels_of_held_out_rows_and_other_columns_are_not_used(tables):
    docs, labels = tables
    some = docs.filter("doc_id < 300")
    first = scores(cl.classify(some, labels))
    turned = labels.withColumn("quality", F.when(cl.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(cl.classify(some.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned)) == first
    again = cl.predict(some.withColumn("doc_id", F.lit(-1).cast("long")), cl.fit(some, labels))
    assert sorted(r["score"] for r in again.collect()) == sorted(s for s, _, _ in first.values())


def labelled():
    r = random.Random(4)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) for _ in range(40)]
    bad = [" ".join(r.choice(["alpha#", "beta$$", "zzz"]) for _ in range(12)) for _ in range(40)]
    return list(enumerate(good + bad)), [(i, int(i < 40), 0) for i in range(80)]


def test_awkward_rows(spark):
    rows, marks = labelled()
    more = [(100, None), (101, ""), (102, "\n\t "), (None, rows[0][1]), (3, rows[3][1]), (103, "zzz " * 100_000), (104, "z" * 1_000_000), (105, rows[70][1])]
    marks += [(None, 1, 0), (500, 1, 0), (100, None, 0), (101, 7, 0), (5, 0, 0), (5, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = cl.classify(frame(spark, rows + more), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(more)
    found = scores(out)
    assert found[100][0] == found[101][0] == found[102][0] and found[None][2] is False and found[None][0] == found[0][0]
    assert found[103][1] == 0 and found[105][0] == found[70][0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sum(found[i][1] == int(i < 40) for i in range(80)) >= 78


def test_one_label_none_and_empty(spark):
    rows, marks = labelled()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    assert {s for s, _, _ in scores(cl.classify(docs, labels.limit(0))).values()} == {0.5}
    assert {p for _, p, _ in scores(cl.classify(docs, labels.filter("quality = 0"))).values()} == {0}
    assert cl.classify(frame(spark, []), labels).count() == 0


def test_sample_is_bounded(spark):
    rows, marks = labelled()
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = cl.sample(frame(spark, rows), labels, "quality", slots=5, per_text=3)
    assert len(got) <= 10 and all(len(at) <= 3 for at, *_ in got)
