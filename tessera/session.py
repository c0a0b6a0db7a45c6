"""Session helpers, table loading and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where a written table lies, as an attribute of the DataFrame that reads it.
_AT = "_tessera_path"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session may do without: it runs in one process, so a folder below its warehouse is shared by all of it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs run inside see ``key`` as ``value``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at a copy every executor can read, so a lost executor
    costs a re-read and not a recomputation. The shuffle files behind the copy go
    as soon as it is written; the copy stays until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, _CLEAN, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _AT, path)
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing unwritten reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, _AT, None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialise`` whose tables, and written ones passed to it, are released at the end: what is to outlive them must be written by then."""
    made: list[DataFrame] = []

    def write(df: DataFrame, name: str = "t") -> DataFrame:
        made.append(df if hasattr(df, _AT) else materialise(df, name))
        return made[-1]

    try:
        yield write
    finally:
        release(*made)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand at most so many rows at a time to Python: whole texts are large, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with setting(spark, key, str(rows) if int(before) <= 0 or int(before) > rows else before):
        yield
