"""Data-quality checks: all row-level expectations of a suite in one aggregation, and cleaning by the same rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if
from .medallion import dedupe_exact


@dataclass(frozen=True)
class Expectation:
    """A rule on one column: kind is column, not_null, between, regex or unique. Nulls fail not_null alone."""

    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"

    def failures(self):
        """Aggregate that counts rows against the rule; None for rules on the schema or on groups."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return count_if(c.isNull())
        if self.kind == "between":
            low = F.lit(False) if self.low is None else c < self.low
            high = F.lit(False) if self.high is None else c > self.high
            return count_if(low | high)
        if self.kind == "regex":
            return count_if(~c.rlike(self.pattern))
        return None


def not_null(column: str) -> Expectation:
    return Expectation("not_null", column)


def between(column: str, low: float | None = None, high: float | None = None) -> Expectation:
    return Expectation("between", column, low, high)


def non_negative(column: str) -> Expectation:
    return between(column, low=0)


def matches(column: str, pattern: str) -> Expectation:
    return Expectation("regex", column, pattern=pattern)


def unique(column: str) -> Expectation:
    return Expectation("unique", column)


def exists(column: str) -> Expectation:
    return Expectation("column", column)


def validate(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """Rows (expectation, failures, success), one for each rule; a missing column fails its rules with null failures.

    Row-level rules share one pass. Uniqueness counts the values that occur more than once, from partial counts.
    """
    spark, there = df.sparkSession, set(df.columns)
    out = None
    for row_level in [[e for e in suite if e.column in there and e.failures() is not None]]:
        if row_level:
            counted = df.agg(*[F.coalesce(e.failures(), F.lit(0)).alias(f"_{i}") for i, e in enumerate(row_level)])
            out = counted.select(F.inline(F.array(*[F.struct(F.lit(e.name).alias("expectation"), F.col(f"_{i}").cast("long").alias("failures")) for i, e in enumerate(row_level)])))
    for e in suite:
        if e.kind == "unique" and e.column in there:
            one = df.where(F.col(e.column).isNotNull()).groupBy(e.column).count().agg(count_if(F.col("count") > 1).alias("failures")).select(F.lit(e.name).alias("expectation"), "failures")
        elif e.column not in there or e.kind == "column":
            one = spark.range(1).select(F.lit(e.name).alias("expectation"), F.lit(0 if e.column in there else None).cast("long").alias("failures"))
        else:
            continue
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "expectation string, failures long")
    return out.withColumn("success", F.coalesce(F.col("failures") == 0, F.lit(False)))


def overall(results: DataFrame) -> DataFrame:
    """One row; a suite without rules succeeds."""
    return results.agg(F.coalesce(F.bool_and("success"), F.lit(True)).alias("success"), F.count("*").alias("checks"), count_if(~F.col("success")).alias("failed"))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def in_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows with every reading inside its bounds, ends included; a null reading is outside."""
    for column, (low, high) in bounds.items():
        df = df.where(F.col(column).between(low, high))
    return df


def validate_and_clean(df: DataFrame, keys: Sequence[str], required: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows with all required columns known and in bounds, once for each key; a table that lacks a column is refused."""
    if missing := missing_columns(df, required):
        raise ValueError(f"missing columns: {missing}")
    return dedupe_exact(in_bounds(df.dropna(subset=list(required)), bounds), keys)


def ingest_stats(df: DataFrame, required: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Counts of rows read, valid, and not valid, in one pass."""
    ok = F.lit(True)
    for c in required:
        ok &= F.col(c).isNotNull()
    for c, (low, high) in bounds.items():
        ok &= F.coalesce(F.col(c).between(low, high), F.lit(False))
    return df.agg(F.count("*").alias("rows_read"), count_if(ok).alias("rows_valid"), count_if(~ok).alias("rows_invalid"))


def quality_report(df: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows (sensor, rows, nulls, mean, std, low, high, out_of_bounds), one for each sensor, and the table's repeated keys."""
    parts = [F.count("*").alias("_rows")]
    for c, (low, high) in bounds.items():
        parts += [count_if(F.col(c).isNull()).alias(f"{c}_n"), F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"), F.min(c).alias(f"{c}_l"), F.max(c).alias(f"{c}_h"),
                  count_if(~F.col(c).between(low, high)).alias(f"{c}_o")]
    rows = F.inline(F.array(*[F.struct(
        F.lit(c).alias("sensor"), F.col("_rows").alias("rows"), F.col(f"{c}_n").alias("nulls"), F.col(f"{c}_m").cast("double").alias("mean"), F.col(f"{c}_s").alias("std"),
        F.col(f"{c}_l").cast("double").alias("low"), F.col(f"{c}_h").cast("double").alias("high"), F.col(f"{c}_o").alias("out_of_bounds")) for c in bounds]))
    repeats = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_keys"))
    return df.agg(*parts).select(rows).crossJoin(F.broadcast(repeats))  # one row
