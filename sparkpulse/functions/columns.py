"""Column expressions that several operators share, with the null and rounding rules of the data they come from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(name: str) -> Column:
    """An identifier without surrounding blanks, in upper case."""
    return F.upper(F.trim(F.col(name)))


def rate(condition: Column) -> Column:
    """Share of rows that meet a condition; rows where it is unknown don't meet it."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def bands(value: Column, edges: Sequence[float], labels: Sequence[str], right: bool) -> Column:
    """The label of the interval a value falls in, closed on the right or the left; null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        inside = (value > low) & (value <= high) if right else (value >= low) & (value < high)
        out = F.when(inside, label).otherwise(out)
    return out


def score_band(value: Column) -> Column:
    """(0, .3] low, (.3, .5] moderate, (.5, .7] high, (.7, 1] critical; 0 itself has no band."""
    return bands(value, [0, 0.3, 0.5, 0.7, 1.0], ["low", "moderate", "high", "critical"], right=True)


def risk_tier(value: Column) -> Column:
    return F.when(value >= 90, "HIGH").when(value >= 50, "MODERATE").otherwise("LOW")


def map_lookup(table: Mapping[str, float], key: Column, default: float = 0.0) -> Column:
    """A number from a literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)


def words(text: Column) -> Column:
    """Words with inner apostrophes, in lower case, by Unicode's letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b[\w']+\b)"), F.lit(1))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; 0 where a column has no spread or there is one row (``corr`` itself fails there)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.when(spread > 0, F.covar_pop(a, b) / spread), F.lit(0.0))


def once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a column that is computed once a row: unlike a projected one, what a generator yields is never inlined."""
    return df.select("*", F.explode(F.array(expression)).alias(name))
