"""A cleaning pipeline over ``documents``: five stages, each written and read again.

Every stage takes the session, the documents that its predecessor kept and the
folder of the tables. All but the last return the columns of ``documents``.
Intermediate tables of a stage are deleted when the next one begins: its input is
written by then.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import bpe, decontaminate, langid, lines, ngram_join
from headway.llm.queries import byte_bpe
from headway.llm.tables import documents, free_name, stage, table
from headway.session import release, staged


def _id() -> Column:
    return F.col("doc_id").cast("long")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. Trained on the labelled rows that came in.

    Where no row has a language nothing can be learned, and nothing goes. A text of any
    length is read whole; rows that repeat an id stay or go together; further columns
    pass through, whatever their names.
    """
    if docs.filter("lang IS NOT NULL").isEmpty():
        return docs
    kept = free_name(docs, "kept")
    known = langid.identify(docs).filter(F.col("lang_pred") != langid.UNKNOWN).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(known, _id().eqNullSafe(F.col(kept)), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go out of their texts; all documents stay, null and emptied texts too.

    Texts of any length are read whole; rows that repeat id and text keep the same lines;
    further columns pass through, whatever their names.
    """
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts (five words, 0.8) the smallest id stays, once if rows repeat id and text; texts without words are no duplicates."""
    groups = ngram_join.link(docs, n=5, percent=80)
    out, key, own = (free_name(docs, n) for n in ("gone", "id_of_row", "own_of_row"))
    gone = groups.filter("n_shingles > 0 AND NOT (doc_id <=> component_id)").select(F.col("doc_id").alias(out)).distinct()
    kept = docs.join(gone, _id().eqNullSafe(F.col(out)), "left_anti")
    # rows without words get a key of their own; the aggregation before the shuffle leaves one row a task of the others
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.withColumns({key: _id(), own: F.when(~words, F.monotonically_increasing_id())})
    return kept.dropDuplicates([key, "text", own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of such an id; null and empty texts hold none.

    Texts of any length are searched whole; further columns pass through, whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: token counts and digests of what is left, a row each; null texts count as empty, any length is encoded whole."""
    return bpe.round_trip(docs, byte_bpe())


_held: list[str] = []


def _owned(function):
    """The stage, preceded by the deletion of the tables that the stage before it made."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _held)
        before = set(staged())
        out = function(spark, docs, sf_dir)
        _held[:] = [p for p in staged() if p not in before]
        return out

    return run_stage


STAGES = [(f.__name__, _owned(f)) for f in (language, line_dedup, near_duplicates, decontamination, encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written as Parquet and read again.

    A stage's table is deleted when the next one's is written; the last one stays, as
    the result reads it, and goes with ``session.release``.
    """
    docs, last = documents(spark, sf_dir), []
    for name, function in STAGES[:-1]:
        before = set(staged())
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, last)
        last = [p for p in staged() if p not in before and f"/pipeline-{name}-" in p]
    return STAGES[-1][1](spark, docs, sf_dir)
