"""Secret scans: a trigram index proposes documents, patterns verify them.

Each rule's pattern is read once on the driver into an and/or query of trigrams
that any match must hold. The index has the postings (trigram, document) of every
trigram that some query names. Counting a document's postings per branch of a
query intersects them; what passes is joined to the texts and verified with the
pattern itself. A rule whose query is empty is verified on every document.

All work on rows is DataFrame functions. Trigrams are looked up in the
lower-cased text, so a query holds whichever case a rule asks for.

Defined cases: null text counts as empty; a document without findings has zero
counts, empty strings, and the digest of the empty string; rows that repeat an id
are verified each, against the union of their postings; a null id is one of its
own kind and verified like any other; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values of the contract, in its order of kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further rules: public formats of keys and tokens.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,200}:([^\s:/@]{1,200})@", 1, 4),
)

MAX_WAYS = 64


def _ways(tree) -> list[str | None]:
    """The strings a part of a pattern can match, lower-cased; [None] where they are not few.

    Only full enumerations count, so a string here stands for the whole part.
    """
    out = [""]
    for op, arg in tree:
        if op is c.LITERAL:
            more = [chr(arg).lower()]
        elif op is c.IN and all(k is c.LITERAL for k, _ in arg) and len(arg) <= 8:
            more = sorted({chr(v).lower() for _, v in arg})
        elif op is c.SUBPATTERN:
            more = _ways(arg[3])
        elif op is c.BRANCH:
            more = [w for branch in arg[1] for w in _ways(branch)]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] <= 2:
            one = _ways(arg[2])
            more = [None] if None in one else ["".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(one, repeat=n)]
        else:
            more = [None]
        if None in more or len(out) * len(more) > MAX_WAYS:
            return [None]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of trigrams: a match holds all trigrams of at least one branch. Empty: no condition.

    The parts of a pattern are joined while they can be enumerated; of the
    stretches so found, the one whose weakest branch has most trigrams is taken.
    """
    best: list[frozenset[str]] = []
    stretch: list = []

    def close() -> None:
        nonlocal best
        ways = _ways(stretch) if stretch else [None]
        if None not in ways:
            branches = sorted({frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in ways}, key=sorted)
            if min(map(len, branches)) > min(map(len, best), default=0):
                best = branches
        stretch.clear()

    for item in parser.parse(pattern):
        if None in _ways([item]):
            close()
        else:
            stretch.append(item)
            if None in _ways(stretch):
                stretch.pop()
                close()
                stretch.append(item)
    close()
    return best


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): which texts hold which of the trigrams, any case."""
    text = F.lower("text")
    held = F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams])
    return (
        docs.filter("text IS NOT NULL").select("doc_id", text.alias("low"))
        .select("doc_id", F.explode(F.array_compact(held)).alias("trigram"))
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """doc_id and the kinds whose trigram query it meets; None if no rule has a query."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    needed = sorted({t for branches in queries.values() for b in branches for t in b})
    if not needed:
        return None
    held = postings(docs, needed).groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))  # at most len(needed) values
    kinds = [
        F.when(
            _any([F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(b))))) == len(b) for b in branches]), F.lit(kind)
        )
        for kind, branches in queries.items() if branches
    ]
    return held.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches that don't overlap, as (start, order, kind, end) in code points; those too short are dropped.

    The pieces between matches and the matches themselves add up to positions.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    sizes = F.transform(whole, F.char_length)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>").alias("found"))
    parts = F.zip_with(F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size"))), F.transform(kept, F.char_length),
                       lambda p, k: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), k.alias("kept")))

    def add(acc, p):
        start = acc["at"] + p["gap"]
        end = start + p["size"]
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["kept"] >= rule.least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.filter(parts, lambda p: p["size"].isNotNull()), step, add)["found"]


def _joined(found: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    )


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans; ``kind:start:end`` by start, then rule order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rules = (*base, *more)
    found = candidates(docs, rules)
    if found is None:
        joined = docs.withColumn("kinds", F.array().cast("array<string>"))
    else:
        found = found.withColumnRenamed("doc_id", "found_id")
        joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    columns = []
    for i, r in enumerate(rules):
        verify = spans(F.col("text"), r, i)
        columns.append((F.coalesce(F.when(F.array_contains("kinds", r.kind), verify), none) if trigram_query(r.pattern) else F.coalesce(verify, none)).alias(f"s{i}"))
    verified = joined.select("doc_id", *columns)
    of_base = F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(base))]))
    of_all = F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))]))
    return verified.select(
        "doc_id", *[F.size(f"s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)],
        F.sha2(_joined(of_base), 256).alias("base_sha256"), _joined(of_all).alias("spans"),
    )

