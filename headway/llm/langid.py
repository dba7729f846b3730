"""Language ID: a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the bytes of a fixed-length window; the
maximum of each filter over the window, rectified, feeds a softmax over the
languages of the training rows. A text is cut into consecutive windows, all of
them are scored in batches, and the mean of their log probabilities, weighted by
letters, decides.

Training rows come from a bounded sample, ``slots`` documents per language and
``per_doc`` windows each, chosen by hash, so that neither one frequent language
nor one source fills it. Only text and language of labelled rows are used.

Defined cases: null text, and text without a letter, is ``und`` with score 0; if
no row is labelled, all documents are ``und``; languages of which no sample row
has text can't be predicted; repeated rows are predicted each; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import map_batches

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
UNKNOWN = "und"
BATCH = 4096


def windows(raw: bytes, limit: int | None = None) -> np.ndarray:
    """Consecutive windows of a text, the last one padded with zeros; with a limit, evenly spaced ones."""
    n = max(1, -(-len(raw) // WINDOW))
    at = np.arange(n) if limit is None or n <= limit else np.linspace(0, n - 1, limit).astype(int)
    padded = np.zeros(n * WINDOW, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return padded.reshape(n, WINDOW)[at]


class Network:
    """One-hot byte convolutions of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.kernels = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)
        self.pairs: list[np.ndarray] | None = None

    def parameters(self) -> list[np.ndarray]:
        return [*self.kernels, self.bias, self.dense, self.offset]

    def convolve(self, x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        """[window, position, filter] before the bias; all widths start at the same positions."""
        span = x.shape[1] - max(WIDTHS) + 1
        out = kernel[0][x[:, :span]]
        for k in range(1, len(kernel)):
            out += kernel[k][x[:, k : k + span]]
        return out

    def freeze(self) -> Network:
        """The kernels as two tables over pairs of bytes, one row for all filters: two look-ups per position."""
        zero = np.zeros((256, FILTERS), np.float32)
        at = lambda kernel, k: kernel[k] if k < len(kernel) else zero
        self.pairs = [
            np.concatenate([(at(w, k)[:, None] + at(w, k + 1)[None]).reshape(65536, FILTERS) for w in self.kernels if len(w) > k], axis=1)
            for k in range(0, max(WIDTHS), 2)
        ]
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The maximum of every filter over each window."""
        two = (x[:, :-1].astype(np.int64) << 8) | x[:, 1:]
        span = x.shape[1] - max(WIDTHS) + 1
        out = np.take(self.pairs[0], two[:, :span], axis=0)
        for k, table in enumerate(self.pairs[1:], 1):
            out[:, :, -table.shape[1] :] += np.take(table, two[:, 2 * k : 2 * k + span], axis=0)
        return out.max(axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.pairs is None:
            self.freeze()
        out = np.empty((len(x), len(self.languages)), np.float32)
        step = 32  # keeps the convolution in the cache
        for i in range(0, len(x), step):
            hidden = np.maximum(self.pooled(x[i : i + step]) + self.bias, 0)
            z = hidden @ self.dense + self.offset
            z -= z.max(axis=1, keepdims=True)
            out[i : i + step] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        rows = np.arange(len(x))
        best, where = [], []
        for kernel in self.kernels:
            out = self.convolve(x, kernel)
            where.append(out.argmax(axis=1))
            best.append(np.take_along_axis(out, where[-1][:, None], 1)[:, 0])
        before = np.concatenate(best, axis=1) + self.bias
        hidden = np.maximum(before, 0)
        z = hidden @ self.dense + self.offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p *= (weight / weight.sum())[:, None]
        back = (p @ self.dense.T) * (before > 0)
        kernels = []
        for i, kernel in enumerate(self.kernels):
            g = np.zeros_like(kernel)
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(len(kernel)):
                np.add.at(g[k], (x[rows[:, None], where[i] + k], np.arange(FILTERS)[None]), part)
            kernels.append(g)
        return [*kernels, back.sum(0), hidden.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
        """Adam over shuffled batches; every language weighs the same."""
        share = np.bincount(y, minlength=len(self.languages)).astype(np.float32)
        weight = (1 / np.maximum(share, 1))[y]
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                step += 1
                lr = rate * (1 - 0.8 * epoch / epochs)
                for p, g, (m, v) in zip(self.parameters(), self.gradients(x[pick], y[pick], weight[pick]), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        return self


def fit(labelled: DataFrame, slots: int = 500, per_doc: int = 4, seed: int = 7) -> Network | None:
    """Train on ``labelled`` (lang, text); None where nothing is labelled. At most slots x per_doc windows per language are collected."""
    slot = F.pmod("mark", F.lit(slots))
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select(
        F.col("lang").cast("string"), F.xxhash64("text").alias("mark"), F.col("text").cast("string")
    )
    # the smallest hash of each slot, then the texts that have it
    chosen = rows.groupBy("lang", slot.alias("slot")).agg(F.min("mark").alias("mark")).collect()
    marks = {(r["lang"], r["mark"]) for r in chosen}
    if not marks:
        return None
    wanted = sorted({m for _, m in marks})

    def run(batches):
        for b in batches:
            for lang, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                yield {"lang": [lang], "mark": [mark], "windows": [windows(raw, per_doc).tobytes()]}

    texts = map_batches(rows.filter(F.col("mark").isin(wanted)), run, "lang string, mark long, windows binary")
    got = texts.groupBy("lang", "mark").agg(F.min("windows").alias("windows")).collect()
    got = sorted((r for r in got if (r["lang"], r["mark"]) in marks), key=lambda r: (r["lang"], r["mark"]))
    languages = sorted({r["lang"] for r in got})
    parts = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in got]
    x = np.concatenate(parts)
    y = np.repeat([languages.index(r["lang"]) for r in got], [len(p) for p in parts])
    return Network(languages, seed).train(x, y, seed=seed).freeze()


def _letters(x: np.ndarray) -> np.ndarray:
    return (((x | 32) >= 97) & ((x | 32) <= 122) | (x >= 128)).sum(axis=1)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and its probability for every document; whole texts."""
    weights = docs.sparkSession.sparkContext.broadcast(network and (network.languages, network.parameters()))

    def run(batches):
        net = None
        if weights.value:
            languages, parameters = weights.value
            net = Network(languages)
            n = len(WIDTHS)
            net.kernels, (net.bias, net.dense, net.offset) = parameters[:n], parameters[n:]
            net.freeze()
        for b in batches:
            texts = b.column(1)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            sums = np.zeros((len(texts), len(net.languages) if net else 1))
            mass = np.zeros(len(texts))

            def flush():
                nonlocal held, size
                if not held:
                    return
                x = np.concatenate([w for _, w in held])
                row = np.repeat([i for i, _ in held], [len(w) for _, w in held])
                weight = _letters(x).astype(float)
                np.add.at(sums, row, net.log_probabilities(x) * weight[:, None])
                np.add.at(mass, row, weight)
                held, size = [], 0

            for i, t in enumerate(texts):
                text = t.as_py()
                if net is None or not text or not any(map(str.isalpha, text)):
                    continue
                w = windows(text.encode("utf-8", "surrogatepass"))
                for j in range(0, len(w), BATCH):
                    held.append((i, w[j : j + BATCH]))
                    size += len(held[-1][1])
                    if size >= BATCH:
                        flush()
            if net is not None:
                flush()
                known = mass > 0
                mean = sums / np.maximum(mass, 1)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for i in np.flatnonzero(known).tolist():
                    lang[i], score[i] = net.languages[best[i]], float(p[i, best[i]])
            yield {"doc_id": b.column(0), "lang_pred": lang, "score": score}

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double"
    )


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: the remainder of the id's CRC-32 by four is two."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the labelled rows that are not held out."""
    network = fit(docs.filter(~held_out()))
    return predict(docs, network).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
