"""Reading tables, staging intermediate tables, running Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from headway.session import stage

__all__ = ["documents", "map_batches", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    return to_arrow_schema(struct)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of equally long columns."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for columns in fn(batches):
            arrays = [columns[f.name] for f in arrow]
            arrays = [a if isinstance(a, pa.Array) and a.type == f.type else pa.array(a, f.type) for a, f in zip(arrays, arrow)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the frame has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Stands for a null id inside an operator; it sorts first.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """key (the id), th (a hash of the text, so that rows that repeat an id stay apart), text."""
    from pyspark.sql import functions as F

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))


def to_id(name: str = "key"):
    from pyspark.sql import functions as F

    return F.when(F.col(name) != NO_ID, F.col(name)).alias("doc_id")


def group_count(docs: DataFrame, group_bytes: int) -> int:
    """How many groups of about ``group_bytes`` of text the documents make, and enough for all tasks."""
    from pyspark.sql import functions as F

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))
