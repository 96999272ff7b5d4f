"""Attribution, nearest-match, latest-value and membership joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import Temporary, stored

#: Spots of drivers that a cell may hold unsplit, and how often a cell is split into 16 at most.
CROWD, DEEPEST = 64, 10
#: Places with their nearest spots that are sent to all executors.
BROADCAST_ROWS = 200_000


def attribute_revenue(ads: DataFrame, orders: DataFrame, user: str, ad_ts: str, order_ts: str, amount: str, campaign: str) -> DataFrame:
    """Revenue by campaign where every ad before an order gets the order's whole amount.

    For a user, an ad's share is the sum of all later orders: a running sum over the user's merged time line gives
    it without the pairs of ads and orders, whose number would grow with the square of a busy user's history.
    """
    line = ads.select(user, F.col(ad_ts).alias("_ts"), F.lit(0).alias("_order"), F.col(campaign).alias("_campaign"), F.lit(None).cast("double").alias("_amount")).unionByName(
        orders.select(user, F.col(order_ts).alias("_ts"), F.lit(1).alias("_order"), F.lit(None).cast(ads.schema[campaign].dataType).alias("_campaign"), F.col(amount).cast("double").alias("_amount")))
    later = Window.partitionBy(user).orderBy(F.col("_ts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(user, "_ts")
    # equal times don't count as later
    sums = line.where(F.col(user).isNotNull() & F.col("_ts").isNotNull()).withColumns({
        "_sum": F.coalesce(F.sum("_amount").over(later), F.lit(0.0)) - F.coalesce(F.sum("_amount").over(same), F.lit(0.0)),
        "_n": F.sum("_order").over(later) - F.sum("_order").over(same)})
    hit = sums.where("_order = 0 AND _n > 0")
    return hit.groupBy(F.col("_campaign").alias(campaign)).agg(F.sum("_sum").alias("revenue"), F.sum("_n").alias("attributed_orders"))


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Facts with columns of a dimension, which may lack the key. Spark broadcasts the dimension if it is small."""
    return facts.join(dimension.select(key, *columns), key, "left")


def latest_values(entities: DataFrame, history: DataFrame, key: str, ts: str, values: Sequence[str], group: str, default: float) -> DataFrame:
    """Each entity's latest known value of each column; else the median of its group over all entities, else a default."""
    latest = history.groupBy(key).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(F.col(ts), F.col(v)))).alias(v) for v in values])
    joined = entities.join(latest, key, "left")
    medians = joined.groupBy(group).agg(*[F.median(v).alias(f"_{v}") for v in values])
    filled = joined.join(medians, group, "left")
    return filled.select(*[c for c in joined.columns if c not in values], *[F.coalesce(v, f"_{v}", F.lit(default)).alias(v) for v in values])


def quadtree(spots: DataFrame, crowd: int, temporary: Temporary) -> tuple[DataFrame, DataFrame]:
    """Nodes (level, x, y, n, low_lat, high_lat, low_lon, high_lon, inner) of an adaptive tree over spots, and the spots with their leaves.

    A cell of more than ``crowd`` spots is split into 16, down to DEEPEST levels; others aren't, however deep their
    neighbours are. A node's bounds are those of its spots. Spots are counted at all levels at once.
    """
    lat, lon = spots.agg(F.struct(F.min("d_lat"), F.max("d_lat")), F.struct(F.min("d_lon"), F.max("d_lon"))).first()
    side = max(lat[1] - lat[0], lon[1] - lon[0], 1e-9)
    most = 4**DEEPEST - 1

    def deep(c: str, low: float) -> Column:
        return F.least(F.floor((F.col(c) - low) / side * (most + 1)), F.lit(most))

    placed = spots.select("*", deep("d_lat", lat[0]).alias("_x"), deep("d_lon", lon[0]).alias("_y"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_x", 2 * (DEEPEST - k)).alias("x"), F.shiftright("_y", 2 * (DEEPEST - k)).alias("y")) for k in range(DEEPEST + 1)])
    bounds = [f(c).alias(f"{name}_{c[2:]}") for c in ("d_lat", "d_lon") for name, f in (("low", F.min), ("high", F.max))]
    every = placed.select("d_lat", "d_lon", F.inline(levels)).groupBy("level", "x", "y").agg(F.count("*").alias("n"), *bounds)
    every = temporary.stored(every.withColumn("inner", (F.col("n") > crowd) & (F.col("level") < DEEPEST)), "quadtree-cells")
    # counts only fall towards the leaves, so a cell is a node if the one above it is split
    above = every.where("inner").select((F.col("level") + 1).alias("level"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    cells = every.withColumns({"_px": F.shiftright("x", 2), "_py": F.shiftright("y", 2)})
    nodes = temporary.stored(cells.join(above, ["level", "_px", "_py"], "left_semi").drop("_px", "_py").unionByName(every.where("level = 0")), "quadtree-nodes")
    leaves = nodes.where("NOT inner").select("level", "x", "y")
    at = placed.select("d_lat", "d_lon", "driver_id", F.inline(levels))
    return nodes, temporary.stored(at.join(leaves, ["level", "x", "y"]), "quadtree-spots")


def nearest_available(orders: DataFrame, drivers: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Each order's nearest driver by straight distance in degrees; ties go to the least driver_id.

    Orders go down a quadtree over the drivers' spots, of which only crowded cells are split, all a level at a time. An
    order keeps the cells that may hold its nearest spot: those no farther than the far corner of some other. So a far
    order meets few cells of a city and few of its drivers, and there are as many rounds as levels, DEEPEST at most.
    Orders at one place go down as one. Of
    drivers at one spot only the least id counts. Orders and drivers without a place are left out; without drivers the
    result is empty; repeated orders give one row.
    """
    every = orders.where("lat IS NOT NULL AND lon IS NOT NULL").select("order_id", (F.col("lat").cast("double") + 0.0).alias("lat"), (F.col("lon").cast("double") + 0.0).alias("lon"))
    known = drivers.where("lat IS NOT NULL AND lon IS NOT NULL")
    with Temporary() as temporary:
        idle = temporary.stored(known.groupBy(F.col("lat").cast("double").alias("d_lat"), F.col("lon").cast("double").alias("d_lon")).agg(F.min("driver_id").alias("driver_id")), "drivers")
        if idle.isEmpty():
            return every.select("order_id", F.lit(None).cast(drivers.schema["driver_id"].dataType).alias("driver_id"), F.lit(None).cast("double").alias("distance")).limit(0)
        nodes, spots = quadtree(idle, crowd, temporary)
        todo = temporary.stored(every.groupBy("lat", "lon").agg(F.min("order_id").alias("order_id")), "places")
        cell = ["level", "x", "y", "inner", "low_lat", "high_lat", "low_lon", "high_lon"]
        root = F.array(F.struct(*cell)).alias("cells")
        state = temporary.stored(todo.crossJoin(F.broadcast(nodes.where("level = 0").select(root))), "orders-0")  # one row
        below = nodes.where("level > 0").select(*[F.col(c).alias(f"_{c}") for c in cell], (F.col("level") - 1).alias("_up"), F.shiftright("x", 2).alias("_ux"), F.shiftright("y", 2).alias("_uy"))
        ready, level = state.where("NOT exists(cells, c -> c.inner)"), 0
        while True:
            level += 1
            split = state.where("exists(cells, c -> c.inner)").select("order_id", "lat", "lon", F.explode("cells").alias("c"))
            grown = split.where("c.inner").join(below, (F.col("c.level") == F.col("_up")) & (F.col("c.x") == F.col("_ux")) & (F.col("c.y") == F.col("_uy")))
            grown = grown.select("order_id", "lat", "lon", F.struct(*[F.col(f"_{c}").alias(c) for c in cell]).alias("c")).unionByName(split.where("NOT c.inner"))
            gathered = grown.groupBy("order_id", "lat", "lon").agg(F.collect_list("c").alias("cells"), F.min(_farthest(F.col("c"))).alias("_most"))
            kept = F.filter("cells", lambda c: _least(c) <= F.col("_most") * (1 + 1e-9) + 1e-12)
            state = temporary.stored(gathered.select("order_id", "lat", "lon", kept.alias("cells")), f"orders-{level}")
            ready = ready.unionByName(state.where("NOT exists(cells, c -> c.inner)"))
            if level == DEEPEST or state.where("exists(cells, c -> c.inner)").isEmpty():
                break
        near = ready.select("order_id", "lat", "lon", F.explode("cells").alias("c")).select("order_id", "lat", "lon", "c.level", "c.x", "c.y").join(spots, ["level", "x", "y"])
        distance = F.sqrt(F.pow(F.col("lat") - F.col("d_lat"), 2) + F.pow(F.col("lon") - F.col("d_lon"), 2))
        best = temporary.stored(near.groupBy("lat", "lon").agg(F.min(F.struct(distance.alias("distance"), "driver_id")).alias("b")), "places-met")
        if todo.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            best = F.broadcast(best)
        met = every.join(best, ["lat", "lon"]).groupBy("order_id").agg(F.min("b").alias("b"))
        return stored(met.select("order_id", "b.driver_id", "b.distance"), "orders-met")


def _least(c: Column) -> Column:
    """Distance of an order from a cell's bounds."""
    away = [F.greatest(c[f"low_{a}"] - F.col(a), F.col(a) - c[f"high_{a}"], F.lit(0.0)) for a in ("lat", "lon")]
    return F.sqrt(away[0] * away[0] + away[1] * away[1])


def _farthest(c: Column) -> Column:
    """Distance of an order from the far corner of a cell's bounds."""
    away = [F.greatest(F.abs(c[f"low_{a}"] - F.col(a)), F.abs(F.col(a) - c[f"high_{a}"])) for a in ("lat", "lon")]
    return F.sqrt(away[0] * away[0] + away[1] * away[1])


def latest_position(pings: DataFrame, key: str, ts: str) -> DataFrame:
    """Each entity's latest row."""
    rest = [c for c in pings.columns if c not in (key, ts)]
    latest = pings.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("_row"))
    return latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in [ts, *rest]])


def previous_period(df: DataFrame, group: Sequence[str], period: str, values: Sequence[str]) -> DataFrame:
    """Add each group's values in the period just before, over the periods of the whole table; null if it has none there."""
    periods = df.select(period).distinct().withColumn("_idx", F.row_number().over(Window.orderBy(period)))
    indexed = df.join(periods, period)
    before = indexed.select(*group, (F.col("_idx") + 1).alias("_idx"), *[F.col(v).alias(f"prev_{v}") for v in values])
    return indexed.join(before, [*group, "_idx"], "left").drop("_idx")


def members(df: DataFrame, column: str, allowed: DataFrame, there: bool = True) -> DataFrame:
    """Rows whose value is, or isn't, in the first column of another table."""
    keys = allowed.select(F.col(allowed.columns[0]).alias(column)).distinct()
    return df.join(keys, column, "left_semi" if there else "left_anti")


