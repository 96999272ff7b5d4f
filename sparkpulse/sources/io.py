"""Readers and writers: thin wrappers with explicit schemas, so that no reader scans a file to guess its types."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """CSV with a schema, or with all columns as text."""
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def copy_into(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header row; a malformed row fails the read."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("mode", "FAILFAST").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """Files that hold one object {key: {...}}: a row for each key."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "v")).select(key, "v.*")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc_incremental(spark: SparkSession, url: str, table: str, updated: str, since_sql: str, split_on: str, low: int, high: int, n: int = 8, **options: str) -> DataFrame:
    """Rows updated since a moment given in the source's SQL, read in ``n`` parts by ranges of a number column."""
    query = f"(SELECT * FROM {table} WHERE {updated} >= {since_sql}) changed"
    return spark.read.format("jdbc").options(url=url, dbtable=query, partitionColumn=split_on, lowerBound=str(low), upperBound=str(high), numPartitions=str(n), **options).load()


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def decode_payloads(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of envelopes of JSON text in any of three shapes: records with base64 data, a list of objects, or one object."""
    records = F.from_json(column, "Records array<struct<kinesis:struct<data:string>>>")["Records"]
    decoded = F.transform(records, lambda r: F.from_json(F.decode(F.unbase64(r["kinesis"]["data"]), "utf-8"), schema))
    listed = F.when(F.ltrim(F.col(column)).startswith("["), F.from_json(column, f"array<struct<{_struct(schema)}>>"))
    single = F.array(F.from_json(column, schema))
    return df.select(F.inline(F.coalesce(decoded, listed, single)))


def _struct(schema: str) -> str:
    return ", ".join(f"{p.split()[0]}:{' '.join(p.split()[1:])}" for p in schema.split(","))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet by partition; only partitions that ``df`` has are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*by).parquet(path)


def write_text_by_hour(df: DataFrame, path: str, ts: str, kind: str = "json") -> None:
    """JSON lines or CSV in folders by year, month, day and hour."""
    parts = {n: F.date_format(ts, f) for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))}
    df.withColumns(parts).write.mode("append").partitionBy(*parts).format(kind).save(path)


def create_table_as(df: DataFrame, name: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def overwrite_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Replace a table by rows that may have been made from it, and read it back.

    The rows are stored first, since a table can't be read while it is replaced.
    """
    with Temporary() as temporary:
        create_table_as(temporary.stored(df, "overwrite"), name, by)
    return df.sparkSession.table(name)


def truncate_insert(df: DataFrame, target: str, keys: Sequence[str]) -> None:
    """Replace a table's rows; the surrogate key is a hash of the keys, so it is the same on every load."""
    full = df.withColumns({"surrogate_key": F.xxhash64(*keys), "created_at": F.current_timestamp()})
    columns = df.sparkSession.table(target).columns
    full.select(*columns).write.insertInto(target, overwrite=True)


def upsert(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``target`` with those of ``source`` in place of rows of the same key, and besides.

    Of source rows that share a key the one that is last by ``order`` counts; ties, and all rows without an order, go
    by their other columns.
    """
    latest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in [*[order] * bool(order), *[c for c in source.columns if c not in (key, order)]]], key)
    source = source.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")
    return target.join(source.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session without one takes its own folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage."""
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored``."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed_path(df.sparkSession, folder)


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


class Temporary:
    """Stored tables that go when the block ends; what outlives it is stored apart."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Temporary:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this block that nothing reads any more."""
        for df in tables:
            self.tables = [t for t in self.tables if t is not df]
            removed(df)

    def __exit__(self, *_) -> None:
        for df in self.tables:
            removed(df)


def store_features(df: DataFrame, root: str, name: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/name={name}/version={version}")


def load_features(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/name={name}/version={version}")


def feature_registry(spark: SparkSession, root: str) -> DataFrame:
    """Rows (name, version, n_rows) of all stored feature sets; the latest version is the largest number."""
    stored = spark.read.option("basePath", root).option("mergeSchema", True).parquet(root)
    return stored.groupBy("name", F.col("version").cast("int").alias("version")).agg(F.count("*").alias("n_rows"))


def latest_version(registry: DataFrame, name: str) -> int | None:
    return registry.where(F.col("name") == name).agg(F.max("version")).first()[0]


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


