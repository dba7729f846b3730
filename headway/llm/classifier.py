"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into words and runs of signs. Its distinct n-grams of one and two of
them, and one for words that repeat the word just before, hashed into a table of fixed
size, are the features of a sparse vector of unit length; a score is the logistic of its product with the weights. Every update keeps
two sums per feature, of gradients and of their squares, from which the weight follows:
features that never tell anything stay at exactly zero, and rates fall feature by feature.

Training rows are a bounded sample: the smallest id hash in each of ``slots`` slots of
each label, at most ``per_text`` features of a text, the most frequent ones. A label
weighs what it weighs among all training rows. Only text and label of rows that are not
held out are used; scoring reads whole texts, and nothing but the text.

Defined cases: null text is an empty one; texts without words get the score of no
feature; labels other than 0 and 1 and labels without a document are ignored; an id
with both labels counts for both; rows that repeat are scored each, and an id trains
once per label, on its smallest text; equal scores are no tie to break; a row without an
id is not held out, and never trains; if nothing is labelled, every score is 0.5, and with one label only that one is
learned; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import map_batches
from headway.llm.words import _VALUES, SPACES, mix, slices, spans_hash

SIZE = 1 << 18
LENGTHS = (1, 2)
#: A word equal to the one so many places before also counts as a word "repeated".
REPEATS = (1, 2)
SLOTS = 3000
PER_TEXT = 2048
#: 0 for separators, 1 for letters, digits and bytes of other characters, 2 for signs.
KIND = np.full(256, 2, np.uint8)
KIND[SPACES] = 0
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    KIND[_low:_high] = 1


def features(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of a slice of texts, by row and feature; the values of a row have unit length."""
    if not len(s.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = KIND[s.data]
    start = np.unique(np.concatenate([np.flatnonzero(np.diff(kind, prepend=255)), s.bounds[:-1][s.bounds[:-1] < len(kind)]]))
    end = np.append(start[1:], len(kind))
    word = kind[start] > 0
    start, end = start[word], end[word]
    row = np.searchsorted(s.bounds, start, "right") - 1
    code = spans_hash(_VALUES[s._bytes], start, end)
    keys = []
    for n in LENGTHS:
        at = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
        keys.append((row[at] << 32) | (spans_hash(code, at, at + n) % np.uint64(SIZE)).astype(np.int64))
    for back in REPEATS:
        again = np.flatnonzero((code[back:] == code[:-back]) & (row[back:] == row[:-back]))
        keys.append((row[again] << 32) | int(mix(np.array([back], np.uint64))[0] % np.uint64(SIZE)))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, value = key >> 32, np.log1p(count)
    length = np.sqrt(np.bincount(row, value * value, minlength=s.n_rows))
    return row, key & (SIZE - 1), value / length[row]


class Leader:
    """Follow the regularised leader, feature by feature; the last entry is the constant."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * weight * x
        after = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = after

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int, float]], epochs: int = 5, seed: int = 7) -> Leader:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                at, x, label, weight = rows[i]
                self.update(np.append(at, SIZE), np.append(x, 1.0), label, weight)
        return self


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: the remainder of the id's CRC-32 by three is one."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, slots: int = SLOTS, per_text: int = PER_TEXT) -> list[tuple[np.ndarray, np.ndarray, int, float]]:
    """Features, label and weight of the training rows: at most 2 x slots texts of at most ``per_text`` features come back."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).withColumn("mark", F.xxhash64("doc_id"))
    slot = F.pmod("mark", F.lit(slots)).alias("slot")
    chosen = rows.groupBy("label", slot).agg(F.min(F.struct("mark", "doc_id")).alias("one"), F.count(F.lit(1)).alias("n"))
    chosen = chosen.select("label", "one.doc_id", "n").collect()  # at most 2 x slots
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(sorted({(r["doc_id"],) for r in chosen}), "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids), "doc_id")

    def run(batches):
        for b in batches:
            for s in slices(b.column(1), lower=True):
                row, at, x = features(s)
                cut = np.searchsorted(row, np.arange(s.n_rows + 1))
                for i in range(s.n_rows):
                    a, v = at[cut[i] : cut[i + 1]], x[cut[i] : cut[i + 1]]
                    top = np.sort(np.lexsort((a, -v))[:per_text])
                    yield {"doc_id": b.column(0)[s.offset + i : s.offset + i + 1], "at": [a[top].astype(np.int32).tobytes()], "x": [v[top].astype(np.float32).tobytes()]}

    found = map_batches(texts, run, "doc_id long, at binary, x binary").groupBy("doc_id").agg(F.min(F.struct("at", "x")).alias("f")).collect()
    found = {r["doc_id"]: r["f"] for r in found}
    share = {k: sum(r["n"] for r in chosen if r["label"] == k) / max(1, sum(r["label"] == k and r["doc_id"] in found for r in chosen)) for k in (0, 1)}
    total = sum(share[r["label"]] for r in chosen if r["doc_id"] in found)
    out = []
    for r in sorted(chosen, key=lambda r: (r["label"], r["doc_id"])):
        if f := found.get(r["doc_id"]):
            at, x = np.frombuffer(f["at"], np.int32).astype(np.int64), np.frombuffer(f["x"], np.float32).astype(float)
            out.append((at, x, r["label"], share[r["label"]] * len(found) / total))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", slots: int = SLOTS, epochs: int = 5) -> np.ndarray:
    """One weight per feature, and the constant."""
    return Leader().train(sample(docs, labels, label, slots), epochs).weights()


def predict(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score, predicted of every document; whole texts."""
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used]))

    def run(batches):
        w = np.zeros(SIZE + 1)
        w[shared.value[0]] = shared.value[1]
        for b in batches:
            score = np.empty(b.num_rows)
            for s in slices(b.column(1), lower=True):
                row, at, x = features(s)
                z = np.bincount(row, w[at] * x, minlength=s.n_rows) + w[SIZE]
                score[s.offset : s.offset + s.n_rows] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield {"doc_id": b.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: trained on the labelled rows that are not held out."""
    return predict(docs, fit(docs, labels, label)).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
