"""Helpers shared by the corpus operators: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sparkpulse-")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all tasks run in this process, a new local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or own_root()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and outlives lost executors.

    ``rows``, where it is known, bounds the number of rows: small tables go to few files, 50,000 rows a task.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(8 + rows // 50_000)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Written tables that go when the block ends; what outlives it is written apart, or read before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        self.tables.append(written(df, name, rows))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this block that nothing reads any more."""
        for df in tables:
            self.tables = [t for t in self.tables if t is not df]
            dropped(self.spark, df)

    def __exit__(self, *_) -> None:
        for df in self.tables:
            dropped(self.spark, df)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within remove their shuffle files when they end, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def barrier(df: DataFrame, name: str, expr) -> DataFrame:
    """Add a column that is computed once a row, even if lambdas use it many times.

    Catalyst inlines projected expressions into later ones, and inside a lambda that would mean once an
    element; it doesn't inline what a generator yields.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_slices(batches: Iterable[pa.RecordBatch], column: str, together: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows in pieces of ``rows`` at most, and of about ``together`` bytes of a text or binary column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + together)) + 1
            end = min(full, start + rows, len(sizes))
            yield batch.slice(start, end - start)
            start = end
