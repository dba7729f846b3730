"""Sharding by extendible hashing: a directory over leading hash bits.

Every document has a 60-bit hash of its id. A bucket is a bit prefix; one that
holds more bytes than a shard may is split on the next bit, and only such a one,
so a document's shard is its shortest prefix that fits. Byte sums are taken once
over cells of ``fine`` leading bits and rolled up from there; cells that are still
too large go on ``step`` bits at a time, over their own documents only.

Defined cases: null text has 0 bytes; a null id hashes like the text ``null``;
rows that can't be told apart by id share their hash, and so does a single row
larger than the limit: they stay in one bucket of full depth with ``fits`` false;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import stage

BITS = 60


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, bytes of the text, hash bits as a number."""
    code = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10)
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), code.cast("long").alias("code")
    )


def _prefix(depth):
    return F.expr(f"shiftright(code, {BITS} - {depth})")


def directory(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(cell, depth, one): for each cell of ``high`` bits the depth of its bucket, at least ``low``; null where even the cell is too large.

    ``one``: all rows of the cell have one hash, so splitting goes no further.
    """
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), (F.min("code") == F.max("code")).alias("one"))
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("held")).filter(F.col("held") <= limit)
    found = levels.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell", "one").join(found, "cell", "left")


def shard(docs: DataFrame, limit: int, fine: int | None = None, step: int = 12) -> DataFrame:
    """doc_id, bytes, depth, shard (the prefix as bits) and whether the shard fits ``limit`` bytes.

    ``fine`` defaults to four bits more than an even split would need.
    """
    rows = keyed(docs)
    if fine is None:
        total = rows.agg(F.sum("bytes")).first()[0] or 0
        fine = min(BITS, max(8, 4 + math.ceil(math.log2(max(1, total / limit)))))
    done = None
    low, high = 0, fine
    while True:
        cells = directory(rows, limit, low, high)
        placed = rows.withColumn("cell", _prefix(high)).join(cells, "cell").drop("cell")
        ready = placed.filter("depth IS NOT NULL OR one").drop("one")
        done = ready if done is None else done.unionByName(ready)
        rows = stage(placed.filter("depth IS NULL AND NOT one").drop("depth", "one"), "shards")
        if rows.isEmpty():
            break
        low, high = high + 1, min(BITS, high + step)
    depth = F.coalesce("depth", F.lit(BITS))
    return done.select(
        "doc_id", "bytes", depth.alias("depth"), F.expr(f"left(lpad(conv(code, 10, 2), {BITS}, '0'), coalesce(depth, {BITS}))").alias("shard"),
        F.col("depth").isNotNull().alias("fits"),
    )


def oracle(limit: int, deepest: int = 24) -> str:
    """The same for DuckDB, to a depth that no bucket of the test tables needs to pass."""
    return f"""WITH k AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {BITS // 4}) AS BIGINT) AS code FROM documents),
      lv AS (SELECT k.*, d.depth, code >> ({BITS} - d.depth) AS bucket FROM k, (SELECT unnest(range(0, {deepest + 1})) AS depth) d),
      b AS (SELECT depth, bucket, sum(bytes) AS held FROM lv GROUP BY ALL),
      p AS (SELECT doc_id, bytes, code, min(depth) AS depth FROM lv JOIN b USING (depth, bucket) WHERE held <= {limit} GROUP BY ALL)
    SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CAST(depth AS INTEGER) AS depth,
      substr(lpad(bin(code), {BITS}, '0'), 1, CAST(depth AS INTEGER)) AS shard, true AS fits FROM p"""
