"""Licence scans: phrases and tags by Aho-Corasick, expressions by shunting-yard.

A text becomes its lower-cased words with single spaces between them; one
automaton finds every phrase in it, whole words only. Where the words of an
identifier tag occur, the original line is read and its and/or/with expression is
evaluated. Every licence has a degree of restriction from 0 (none) to 1; ``or``
takes the freer side, ``and`` the stricter one, ``with`` an exception halves the
degree. The score of a document is the strictest of what it states.

Defined cases: null text counts as empty; a document without findings has empty
labels, null word positions and score 0; a malformed expression contributes the
labels of the names in it and the strictest of them; repeated rows are scanned
each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import map_batches

#: Fixed values of the contract: phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "public-domain",
}
TAG = "spdx license identifier"
#: Degree of restriction of a label.
DEGREE = {
    "public-domain": 0.05, "cc0": 0.05, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.15, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4,
    "cc-by-sa": 0.5, "lgpl": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "reserved": 1.0,
}
UNKNOWN = 0.6
BINDS = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes(
    0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)
_EXPRESSION = re.compile(r"spdx-license-identifier[^\S\n]*:?[^\S\n]*([^\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")


def label_of(name: str) -> str:
    """The family of a licence identifier, or the identifier itself."""
    name = name.lower().rstrip("+")
    for family in sorted(DEGREE, key=len, reverse=True):
        if name == family or name.startswith(family + "-") or (family == "public-domain" and name in ("unlicense", "0bsd")):
            return family
    return name


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and degree of restriction of an and/or/with expression.

    Reading stops where the expression can't go on, so prose after it is ignored.
    """
    names: set[str] = set()
    values: list[float] = []
    pending: list[str] = []
    want_name = True

    def reduce_top() -> None:
        op = pending.pop()
        if op == "(" or len(values) < 2:
            return
        right, left = values.pop(), values.pop()
        values.append(min(left, right) if op == "or" else max(left, right) if op == "and" else left / 2)

    for token in _TOKEN.findall(expression):
        word = token.lower()
        if want_name:
            if token == "(":
                pending.append(token)
            elif token == ")" or word in BINDS:
                break
            else:
                exception = bool(pending) and pending[-1] == "with"
                label = label_of(token)
                if not exception:
                    names.add(label)
                values.append(0.0 if exception else DEGREE.get(label, UNKNOWN))
                want_name = False
        elif token == ")":
            if "(" not in pending:
                break
            while pending[-1] != "(":
                reduce_top()
            pending.pop()
        elif word in BINDS:
            while pending and pending[-1] != "(" and BINDS[pending[-1]] >= BINDS[word]:
                reduce_top()
            pending.append(word)
            want_name = True
        else:
            break
    if want_name and pending and pending[-1] in BINDS:
        pending.pop()  # an operator without a right side
    while pending:
        reduce_top()
    return names, max(values, default=0.0)


class Scanner:
    """The automaton over all phrases."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, TAG}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        base, method, first, last, n_base, tagged = set(), set(), None, None, 0, False
        at_char = at_word = 0
        for end, phrase in self.automaton.iter(line):
            if phrase == TAG:
                tagged = True
            if phrase in NOTICES:
                method.add(NOTICES[phrase])
            if phrase in BASE:
                start = end - len(phrase)  # of the phrase's first letter
                at_word += line.count(" ", at_char, start) if start >= at_char else -line.count(" ", start, at_char)
                at_char = start
                place = at_word - 1
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
                n_base += 1
                base.add(BASE[phrase])
        degrees = [DEGREE[x] for x in base | method]
        if tagged:
            for m in _EXPRESSION.finditer(text):
                names, degree = evaluate(m[1])
                method |= names
                degrees += [degree] if names else []
        return {
            "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | method)), "score": max(degrees, default=0.0),
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: places, labels and degree of restriction."""

    def run(batches):
        scanner = Scanner()
        for b in batches:
            rows = [scanner.scan(t.as_py() or "") for t in b.column(1)]
            if rows:
                yield {"doc_id": b.column(0)} | {k: [r[k] for r in rows] for k in rows[0]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
