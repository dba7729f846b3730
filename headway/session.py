"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "headway", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the clock set to UTC."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def utc(spark: SparkSession) -> SparkSession:
    """Operators reason in UTC; named zones are always explicit arguments."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the
    session runs in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="headway-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_staged: list[str] = []
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged() -> list[str]:
    """Paths of the tables that :func:`stage` has written and nobody has released."""
    return list(_staged)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete staged tables, all by default; call it when the results made from them are written."""
    paths = staged() if paths is None else [p for p in paths if p in _staged]
    for path in paths:
        _staged.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage of a multi-step plan: later steps, and retries after a lost
    executor, start from the table instead of repeating what led to it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    _staged.append(path)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")  # the shuffle files of this write are of no use after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
