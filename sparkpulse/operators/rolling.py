"""Rolling features of time series, trends by period, and shifts.

Frames count rows, not time. Series are dealt out in the order of their rows, long ones in blocks that begin with the
rows that the first frames reach back to. A task reads its rows in order, an Arrow batch at a time behind the last rows
of the batch before, and makes all frames of a batch by whole columns; so neither a series nor a frame is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.io import stored
from .joins import previous_period
from .ordered import numbered

WINDOWS = (15, 60, 360)
LAGS = (5, 15, 60)
#: Rows of a series that one task reads, besides those that its first frames reach back to.
BLOCK_ROWS = 10_000
Made = list[tuple[str, np.ndarray, np.ndarray | None]]


@dataclass
class Line:
    """Rows in order: each column's numbers, which of them aren't null, its series' first number, and how many rows of its series come before each."""

    values: dict[str, np.ndarray]
    known: dict[str, np.ndarray]
    first: dict[str, tuple[np.ndarray, np.ndarray]]
    since: np.ndarray

    def earlier(self, x: np.ndarray, k: int, otherwise) -> np.ndarray:
        """``x`` of the row ``k`` rows before, in the same series."""
        if not k:
            return x
        out = np.full_like(x, otherwise)
        out[k:] = x[:-k]
        out[self.since < k] = otherwise
        return out


def _shorter(size: int, sizes: Sequence[int] = ()) -> int:
    """A frame's part: the largest given size that divides it, else its largest divisor up to its root; itself if that is tiny."""
    given = [n for n in sizes if n < size and size % n == 0]
    part = max(given, default=0) or max(d for d in range(1, isqrt(size) + 1) if size % d == 0)
    return part if part >= 4 else size


def _sums(parts: Sequence[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def _joined(line: Line, part: dict[str, np.ndarray], size: int, step: int, central: dict[str, tuple[str, ...]]) -> dict[str, np.ndarray]:
    """Counts, means, central sums, and least and greatest values of a frame, from those of its parts ``step`` rows apart.

    ``central`` names, for each central sum of degree two, the means that it is about.
    """
    lags = range(0, size, step)
    n = [line.earlier(part["n"], k, 0.0) for k in lags]
    out = {"n": _sums(n)}
    away = {}
    for m in {m for pair in central.values() for m in pair}:
        means = [np.where(c > 0, line.earlier(part[m], k, 0.0), 0.0) for c, k in zip(n, lags, strict=True)]
        out[m] = _sums([c * x for c, x in zip(n, means, strict=True)]) / out["n"]
        away[m] = [np.where(c > 0, x - out[m], 0.0) for c, x in zip(n, means, strict=True)]
    for s, (a, b) in central.items():
        out[s] = _sums([line.earlier(part[s], k, 0.0) + c * u * v for c, k, u, v in zip(n, lags, away[a], away[b], strict=True)])
    if "m3" in part:
        out["m3"] = _sums([line.earlier(part["m3"], k, 0.0) + u * (3 * line.earlier(part["m2"], k, 0.0) + c * u * u) for c, k, u in zip(n, lags, away["mean"], strict=True)])
    for name in part:
        if name.startswith("low"):
            out[name] = np.minimum.reduce([line.earlier(part[name], k, np.inf) for k in lags])
        elif name.startswith("high"):
            out[name] = np.maximum.reduce([line.earlier(part[name], k, -np.inf) for k in lags])
    return out


def _directly(line: Line, columns: Sequence[str], size: int) -> dict[str, np.ndarray]:
    """The same of a frame of few rows, in two passes over its rows; rows that lack one of the columns don't count."""
    known = np.logical_and.reduce([line.known[c] for c in columns])
    here = [line.earlier(known, k, False) for k in range(size)]
    out, away = {"n": _sums(here).astype(float)}, []
    for c, mean in zip(columns, ("mean", "mean_b"), strict=False):
        x = [line.earlier(line.values[c], k, 0.0) for k in range(size)]
        out[mean] = _sums([np.where(ok, v, 0.0) for ok, v in zip(here, x, strict=True)]) / out["n"]
        away.append([np.where(ok, v - out[mean], 0.0) for ok, v in zip(here, x, strict=True)])
        tail = mean.removeprefix("mean")
        out["low" + tail] = np.minimum.reduce([np.where(ok, v, np.inf) for ok, v in zip(here, x, strict=True)])
        out["high" + tail] = np.maximum.reduce([np.where(ok, v, -np.inf) for ok, v in zip(here, x, strict=True)])
    flat = out["low"] == out["high"]  # rounded sums of squares can't tell
    out["m2"] = np.where(flat, 0.0, _sums([d * d for d in away[0]]))
    if len(columns) == 1:
        out["m3"] = np.where(flat, 0.0, _sums([d**3 for d in away[0]]))
    else:
        out["m2_b"], out["m2_ab"] = _sums([d * d for d in away[1]]), _sums([d * e for d, e in zip(*away, strict=True)])
    return out


def _stats(columns: Sequence[str], sizes: Sequence[int]) -> Callable[[Line], Made]:
    def make(line: Line) -> Made:
        out = {}
        for c in columns:
            done: dict[int, dict] = {}
            for size in sorted(sizes):
                part = _shorter(size, sizes)
                if part not in done:
                    done[part] = _directly(line, [c], part)
                if size not in done:
                    done[size] = _joined(line, done[part], size, part, {"m2": ("mean", "mean")})
                m = done[size]
                flat = m["low"] == m["high"]
                m["m2"], m["m3"] = np.where(flat, 0.0, m["m2"]), np.where(flat, 0.0, m["m3"])
                n, std = m["n"], np.sqrt(m["m2"] / (m["n"] - 1))
                skew = np.sqrt(n * (n - 1)) / (n - 2) * np.sqrt(n) * m["m3"] / m["m2"] ** 1.5
                out[size, c] = [(f"{c}_mean_{size}", m["mean"], n == 0), (f"{c}_std_{size}", np.where(n > 1, std, 0.0), None),
                                (f"{c}_skew_{size}", np.where((n >= 3) & (m["m2"] > 0) & ~np.isnan(skew), skew, 0.0), None)]
        return [x for size in sizes for c in columns for x in out[size, c]]

    return make


def _changes(columns: Sequence[str]) -> Callable[[Line], Made]:
    def make(line: Line) -> Made:
        out = []
        for c in columns:
            x, known = line.values[c], line.known[c]
            d = np.where(known & line.earlier(known, 1, False), x - line.earlier(x, 1, 0.0), 0.0)
            out += [(f"{c}_roc", d, None), (f"{c}_roc_abs", np.abs(d), None)]
        return out

    return make


def _lags(columns: Sequence[str], steps: Sequence[int]) -> Callable[[Line], Made]:
    def make(line: Line) -> Made:
        out = []
        for c in columns:
            first, first_known = line.first[c]
            for k in steps:
                known = line.earlier(line.known[c], k, False)
                out.append((f"{c}_lag_{k}", np.where(known, line.earlier(line.values[c], k, 0.0), first), ~known & ~first_known))
        return out

    return make


def _correlated(columns: Sequence[str], size: int) -> Callable[[Line], Made]:
    part, least = _shorter(size), max(size // 2, 2)

    def make(line: Line) -> Made:
        out = []
        for a, b in combinations(columns, 2):
            m = _joined(line, _directly(line, [a, b], part), size, part, {"m2": ("mean", "mean"), "m2_b": ("mean_b", "mean_b"), "m2_ab": ("mean", "mean_b")})
            spread = np.sqrt(m["m2"]) * np.sqrt(m["m2_b"])
            good = (m["n"] >= least) & (m["low"] < m["high"]) & (m["low_b"] < m["high_b"]) & (spread > 0)
            out.append((f"corr_{a}_{b}", np.where(good, m["m2_ab"] / spread, 0.0), None))
        return out

    return make


def _peaks(columns: Sequence[str], size: int) -> Callable[[Line], Made]:
    def make(line: Line) -> Made:
        out = []
        for c in columns:
            x, n = np.where(line.known[c], line.values[c], 0.0), np.minimum(line.since + 1, size)
            peak = np.zeros(len(x))
            for length in np.unique(n[n >= 4]):
                for at in np.array_split(np.flatnonzero(n == length), 1 + np.count_nonzero(n == length) // 10_000):
                    frame = x[at[:, None] - np.arange(length - 1, -1, -1)]
                    power = np.abs(np.fft.rfft(frame - frame.mean(axis=1, keepdims=True), axis=1))[:, 1:]
                    peak[at] = np.round(np.fft.rfftfreq(length)[1:][power.argmax(axis=1)], 4)
            out.append((f"{c}_fft_peak", peak, None))
        return out

    return make


def in_blocks(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add _block, _lead and _first to the rows of series, those of long series in blocks of ``block_rows``.

    A block begins with copies of the ``reach`` rows before it, which are marked as its lead; _first holds the columns of
    the series' first row, null in the first block. A series of at most ``block_rows`` rows is one block. Series are
    long only if they have more rows than that, so there is at most one for as many rows of the table.
    """
    first = F.struct(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(columns)])
    by = df.groupBy(F.col(entity).alias("_entity")).agg(F.count("*").alias("_n"), F.min_by(first, F.struct(*order)).alias("_first"))
    long = stored(by.where(F.col("_n") > block_rows), "long-series")
    none = F.lit(None).cast(long.schema["_first"].dataType)
    plain = {"_block": F.lit(0).cast("long"), "_lead": F.lit(False), "_first": none}
    if long.isEmpty():
        return df.withColumns(plain)
    same = F.col(entity).eqNullSafe(F.col("_entity"))
    placed = numbered(df.join(long, same), [entity], order, "series")
    block = F.floor(F.col("_pos") / block_rows)
    again = (F.col("_pos") % block_rows >= block_rows - reach) & ((block + 1) * block_rows < F.col("_n"))
    copies = F.filter(F.array(F.struct(block.alias("_block"), F.lit(False).alias("_lead")), F.when(again, F.struct((block + 1).alias("_block"), F.lit(True).alias("_lead")))), lambda x: x.isNotNull())
    split = placed.select(*df.columns, "_first", F.inline(copies)).withColumn("_first", F.when(F.col("_block") > 0, F.col("_first")))
    return df.join(long.select("_entity"), same, "left_anti").withColumns(plain).unionByName(split)


def _numbers(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column with 0 for nulls, and where it isn't null."""
    column = rows.column(name).combine_chunks()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, column.to_numpy(zero_copy_only=False), 0.0), known


def rolled(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], makers: Sequence[Callable[[Line], Made]], names: Sequence[str], reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the columns that the makers make of each row and the ``reach`` rows of its series before it.

    Series are rows of one entity; null entities are one series. Rows alike in ``order`` come in any order, so it should
    tell all rows apart. Columns count as doubles. Columns of ``df`` that have a made column's name are replaced.
    """
    kept = [c for c in df.columns if c not in names]
    blocks = in_blocks(df, entity, order, columns, reach, block_rows)
    values = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)]
    dealt = blocks.repartition(entity, "_block").sortWithinPartitions(entity, "_block", *order)
    line = F.xxhash64(F.struct(F.col(entity).isNull(), entity, "_block")).alias("_line")
    source = dealt.select(*kept, *values, "_lead", (F.col("_block") > 0).alias("_later"), *[F.col(f"_first.f{k}").alias(f"_f{k}") for k in range(len(columns))], line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last rows of the batch before; of the first of them, the rows before it and its series' first values
        before, firsts = 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rows = now if held is None else pa.concat_tables([held, now])
            old, which = rows.num_rows - now.num_rows, rows.column("_line").to_numpy()
            start = np.maximum.accumulate(np.where(np.r_[True, which[1:] != which[:-1]], np.arange(len(which)), 0))
            since = np.arange(len(which)) - start + np.where(start == 0, before, 0)
            later = rows.column("_later").to_numpy()  # not in the first block of a series
            x, known, first = {}, {}, {}
            for k, c in enumerate(columns):
                x[c], known[c] = _numbers(rows, f"_x{k}")
                given, is_given = _numbers(rows, f"_f{k}")
                own, own_known = x[c][start], known[c][start]
                if old:
                    own, own_known = np.where(start == 0, firsts[c][0], own), np.where(start == 0, firsts[c][1], own_known)
                first[c] = np.where(later, given, own), np.where(later, is_given, own_known)
            with np.errstate(all="ignore"):
                made = [m for make in makers for m in make(Line(x, known, first, since))]
            out = now.select(kept)
            for name, v, null in made:
                out = out.append_column(name, pa.array(v[old:], pa.float64(), mask=None if null is None else null[old:]))
            yield from out.filter(pc.invert(now.column("_lead"))).to_batches()
            at = max(0, rows.num_rows - max(reach, 1))
            held, before, firsts = rows.slice(at), int(since[at]), {c: (v[at], ok[at]) for c, (v, ok) in first.items()}

    schema = StructType([*[df.schema[c] for c in kept], *[StructField(n, DoubleType()) for n in names]])
    return source.mapInArrow(run, schema)


def _names(make: Callable[[Line], Made], columns: Sequence[str]) -> list[str]:
    none = {c: np.zeros(0) for c in columns}
    with np.errstate(all="ignore"):
        return [n for n, *_ in make(Line(none, {c: np.zeros(0, bool) for c in columns}, {c: (np.zeros(0), np.zeros(0, bool)) for c in columns}, np.zeros(0, np.int64)))]


def rolling_stats(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], sizes: Sequence[int] = WINDOWS) -> DataFrame:
    """Add mean, standard deviation and skewness over the last rows; 0 where too few rows define the latter two.

    A frame of 60 rows is made of the moments of four frames of 15, one of 360 of six frames of 60: 25 steps a row in
    place of 435, and, unlike differences of running sums, as exact for long or steeply rising series. Nulls aren't
    counted; a value that isn't finite spoils only the frames that hold it.
    """
    return _added(df, entity, order, columns, [_stats(columns, sizes)], max(sizes) - 1)


def correlations(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], size: int = 60) -> DataFrame:
    """Add the rolling correlation of all pairs; 0 before half a frame is there, and where a column has no spread.

    As in ``rolling_stats``, shorter frames make up the whole one. Only rows that have both values count.
    """
    return _added(df, entity, order, columns, [_correlated(columns, size)], size - 1)


def features(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], peaks: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rolling features beside the given columns, in one pass: statistics, changes, lags, correlations, and peaks if asked for.

    Changes and lags are those of rows; before the series began, a lag is its first value, as is that of a null.
    """
    makers = [_stats(columns, WINDOWS), _changes(columns), _lags(columns, LAGS), _correlated(columns, 60), *([_peaks(columns, 60)] if peaks else [])]
    return _added(df, entity, order, columns, makers, max(*WINDOWS, *LAGS) - 1, block_rows)


def fft_peak(df: DataFrame, entity: str, order: Sequence[str], column: str, size: int = 60) -> DataFrame:
    """Add the dominant frequency of each row's frame, its mean removed and nulls as 0; 0 for fewer than four rows."""
    return _added(df, entity, order, [column], [_peaks([column], size)], size - 1)


def _added(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], makers: Sequence[Callable[[Line], Made]], reach: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return rolled(df, entity, order, columns, makers, [n for make in makers for n in _names(make, columns)], reach, block_rows)


def period_change(df: DataFrame, group: str, period: str, value: str, least: int = 20) -> DataFrame:
    """Mean, deviation and count for each group and period of enough rows, and the change against the period just before."""
    by = df.groupBy(group, period).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")).where(F.col("n") >= least)
    return previous_period(by, [group], period, ["mean"]).withColumn("change", F.col("mean") - F.col("prev_mean")).drop("prev_mean")


def shifts(trends: DataFrame, group: str, period: str, notable: float = 0.15, significant: float = 0.3) -> DataFrame:
    """Changes of notable size, with the group's period before as ``period_from``."""
    w = Window.partitionBy(group).orderBy(period)
    out = trends.withColumn("period_from", F.lag(period).over(w)).where(F.abs("change") >= notable)
    return out.select(group, "period_from", F.col(period).alias("period_to"), "change",
                      F.when(F.abs("change") >= significant, "significant").otherwise("notable").alias("severity"),
                      F.when(F.col("change") > 0, "improving").otherwise("declining").alias("direction"))


def divergence(trends: DataFrame, group: str, period: str, limit: float = 0.05) -> DataFrame:
    """Slope of each group's distance from the mean of all groups over its periods, labelled by size and sign."""
    everywhere = trends.groupBy(period).agg(F.avg("mean").alias("org_mean"))
    line = trends.join(everywhere, period).withColumns({"deviation": F.col("mean") - F.col("org_mean"), "step": F.row_number().over(Window.partitionBy(group).orderBy(period)) - 1})
    by = line.groupBy(group).agg(F.regr_slope("deviation", "step").alias("slope"), F.max_by("deviation", period).alias("latest_deviation"), F.count("*").alias("periods")).where("periods >= 2")
    return by.withColumn("trend", F.when(F.col("slope") > limit, "diverging_up").when(F.col("slope") < -limit, "diverging_down").otherwise("stable"))


def trend_summary(trends: DataFrame, found: DataFrame, group: str, period: str) -> DataFrame:
    """One row of counts over trends and the shifts found in them."""
    a = trends.agg(F.countDistinct(period).alias("periods"), F.countDistinct(group).alias("groups"))
    b = found.agg(F.count("*").alias("alerts"), *[F.count_if(F.col(c) == v).alias(v) for c, v in (("severity", "significant"), ("direction", "declining"), ("direction", "improving"))])
    return a.crossJoin(F.broadcast(b))  # one row each


def average_rank(df: DataFrame, by: str) -> DataFrame:
    """Add the rank by size from the top; equal sizes share their mean rank, cut to a whole number, and nulls come last.

    Sizes are counted, then dealt by range: the totals of the ranges before carry over, so no task sees all rows.
    """
    counts = df.groupBy(F.col(by).alias("_size")).agg(F.count("*").alias("_n"))
    dealt = stored(counts.repartitionByRange(F.desc("_size")).withColumn("_part", F.spark_partition_id()), "sizes")
    parts = dealt.groupBy("_part").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    inside = Window.partitionBy("_part").orderBy(F.desc("_size"))
    first = F.sum("_n").over(inside) - F.col("_n") + F.col("_before")
    ranks = dealt.join(F.broadcast(offsets), "_part").select("_size", (first + 1 + (F.col("_n") - 1) / 2).cast("int").alias("rank"))
    return df.join(ranks, F.col(by).eqNullSafe(F.col("_size"))).drop("_size")


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first rows in an order that tells all rows apart, so that a capped batch is the same on every run."""
    return df.orderBy(*order).limit(n)


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
