"""Quality rules: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at counts of one document and votes good, bad or abstains. The
votes of all documents that the base rules leave open are counted by pattern (at most ``3 ** len(RULES)`` rows,
whatever the corpus); on these counts EM fits, for each hidden class, how often
each rule votes which way. A document is kept when its posterior probability of
being good is at least ``keep_at``.

Defined cases: null text counts as empty (no words, so the base rule fails it);
an empty table gives an empty result; repeated rows are judged each; further
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import map_batches, stage
from headway.llm.words import slices, spans_hash, mix, _VALUES

WINDOW = 8
#: Fixed values of the contract.
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

FEATURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct long, n_upper long, n_ascii_letters long, n_shout long, n_digits long, n_marked long"
)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its code occur again in its row; is it a later occurrence."""
    key = mix(code + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def _in_class(data: np.ndarray, chars) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.asarray(chars)] = True
    return table[data]


def text_counts(texts):
    """Counts of every row of a string array, as dicts of arrays."""
    for s in slices(texts):
        n = s.n_rows
        inside = np.zeros(len(s.data) + 1, np.int8)
        np.add.at(inside, s.start, 1)
        np.add.at(inside, s.end, -1)
        in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        in_word &= (s.data & 0xC0) != 0x80
        # lines: cut at every newline and at every row's end
        is_nl = s.data == 10
        nl = np.flatnonzero(is_nl)
        row_of_nl = np.searchsorted(s.bounds, nl, "right") - 1
        l_start = np.concatenate([s.bounds[:-1], nl + 1])
        l_end = np.concatenate([nl, s.bounds[1:]])
        l_row = np.concatenate([np.arange(n), row_of_nl])
        order = np.lexsort((l_start, l_row))
        l_start, l_row = l_start[order], l_row[order]
        l_end = np.concatenate([nl, s.bounds[1:]])[np.lexsort((np.concatenate([nl, s.bounds[1:]]), np.concatenate([row_of_nl, np.arange(n)])))]
        worded = np.searchsorted(s.start, l_end) > np.searchsorted(s.start, l_start)
        l_start, l_end, l_row = l_start[worded], l_end[worded], l_row[worded]
        _, l_later = _repeats(l_row, spans_hash(_VALUES[s.data], l_start, l_end))
        at, code = s.grams(WINDOW)
        again, _ = _repeats(s.row[at], code)
        cover = np.zeros(len(s.start) + 1, np.int32)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        _, w_later = _repeats(s.row, s.code)
        last = s.data[s.end - 1] if len(s.end) else np.zeros(0, np.uint8)
        symbol = _in_class(s.data, SYMBOLS)
        upper = (s.data >= 0x41) & (s.data <= 0x5A)
        total = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(symbol, out=total[1:])
        marked = total[s.end] > total[s.start]
        yield s, {
            "n_words": s.n_words, "word_chars": _sums(in_word, s.bounds), "n_symbols": _sums(symbol, s.bounds),
            "n_dup_lines": np.bincount(l_row[l_later], minlength=n), "n_repeat_words": np.bincount(s.row[covered], minlength=n),
            "n_lines": np.bincount(l_row, minlength=n), "n_distinct": np.bincount(s.row[~w_later], minlength=n),
            "n_upper": _sums(upper, s.bounds), "n_ascii_letters": _sums(upper | ((s.data >= 0x61) & (s.data <= 0x7A)), s.bounds),
            "n_shout": np.bincount(s.row[last == 0x21], minlength=n), "n_digits": _sums((s.data >= 0x30) & (s.data <= 0x39), s.bounds), "n_marked": np.bincount(s.row[marked], minlength=n),
        }


def features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for s, counts in text_counts(b.column(1)):
                yield {"doc_id": b.column(0).slice(s.offset, s.n_rows)} | counts

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, FEATURES)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def rules() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, 2 abstains."""
    c, n = F.col, F.col("n_words")
    share = lambda x: c(x) / F.greatest(n, F.lit(1))
    length = c("word_chars") / F.greatest(n, F.lit(1))
    upper = c("n_upper") / F.greatest(c("n_ascii_letters"), F.lit(1))
    return {
        "length": _vote(n >= 30, n < MIN_WORDS),
        "repeats": _vote(share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.3),
        "symbols": _vote(share("n_symbols") < 0.05, share("n_symbols") > 0.3),
        "clutter": _vote(share("n_marked") < 0.05, share("n_marked") > 0.3),
        "lines": _vote((c("n_lines") > 1) & (c("n_dup_lines") == 0), c("n_dup_lines") > 0.3 * c("n_lines")),
        "word_length": _vote(length.between(3.5, 8), (length < 2.5) | (length > 12)),
        "capitals": _vote(upper < 0.2, upper > 0.5),
        "variety": _vote(share("n_distinct") > 0.5, (n.between(20, 400)) & (share("n_distinct") < 0.3)),
        "shouting": _vote(c("n_shout") == 0, share("n_shout") > 0.3),
        "digits": _vote(c("n_digits") < 0.05 * c("word_chars"), c("n_digits") > 0.3 * c("word_chars")),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tol: float = 1e-9, strength: float = 0.05) -> tuple[float, np.ndarray]:
    """EM over vote patterns: P(good) and P(vote | class) as [rule, class, vote]; class 1 is good.

    The start says that a bad document breaks some rules, not most of them, and a
    good one hardly any. It stays in the fit as a prior worth ``strength`` times the
    documents, so that a class can't drift to documents that merely vote alike.
    """
    n_rules = patterns.shape[1]
    prior = 0.8
    table = np.empty((n_rules, 2, 3))
    table[:, 0], table[:, 1] = (0.3, 0.5, 0.2), (0.02, 0.78, 0.2)
    start = strength * (counts.sum() + 1) * table
    for _ in range(rounds if len(counts) else 0):
        log = np.log(table)[np.arange(n_rules), :, patterns].sum(1) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        weight = np.stack([counts * (1 - good), counts * good])
        new_prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        new = start.copy()
        for r in range(n_rules):
            for v in range(3):
                new[r, :, v] += weight[:, patterns[:, r] == v].sum(1)
        new /= new.sum(2, keepdims=True)
        # a rule never counts against its own meaning
        flip = new[:, 0, 0] * new[:, 1, 1] < new[:, 0, 1] * new[:, 1, 0]
        new[flip] = new[flip].mean(1, keepdims=True)
        moved = max(abs(new_prior - prior), np.abs(new - table).max())
        prior, table = new_prior, new
        if moved < tol:
            break
    return float(prior), table


def judge(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, score (posterior) and the rules' votes as ``vote_<rule>``."""
    counts = stage(features(docs), "quality")
    votes = {f"vote_{k}": v for k, v in rules().items()}
    names = list(votes)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    voted = counts.withColumns(votes | {"base_failed": failed})
    seen = voted.filter("not base_failed").groupBy(*names).count().collect()
    patterns = np.array([[r[k] for k in names] for r in seen], int).reshape(-1, len(names))
    prior, table = fit(patterns, np.array([r["count"] for r in seen], float))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for i, k in enumerate(names):
        w = [float(x) for x in np.log(table[i, 1] / table[i, 0])]
        odds = odds + F.when(F.col(k) == 0, w[0]).when(F.col(k) == 1, w[1]).otherwise(w[2])
    score = 1 / (1 + F.exp(-odds))
    return voted.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_at))
