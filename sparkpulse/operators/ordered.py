"""Places of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ordered") -> DataFrame:
    """Add ``_pos``, each row's place in its group from 0.

    Rows are dealt out by ranges of group and order; a group's rows in earlier ranges come before a row's place in its
    own. Rows alike in all of ``order`` get places side by side, in any order. Nulls come first.
    """
    keys = [*group, *order]
    dealt = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    # a row for each group and range that meet: their number together at most
    pieces = dealt.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*[f"_g{k}" for k in range(len(group))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    same = part == F.col("_part")
    for k, g in enumerate(group):
        same &= dealt[g].eqNullSafe(F.col(f"_g{k}"))
    return dealt.join(begins, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("_pos"))
