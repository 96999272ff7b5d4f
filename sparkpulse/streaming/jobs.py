"""Structured Streaming jobs, each with a batch twin of the same result where a batch can have one."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.columns import count_if
from ..operators.joins import latest_position, nearest_available
from ..operators.ml import severity

#: The state of transformWithState lives in RocksDB.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a zone; the session's is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Counts by window and kind; the watermark lets finished windows leave the state."""
    df = event_time(events, ts)
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    return df.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def session_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user end after a gap; streams emit them in append mode once the watermark has passed."""
    df = event_time(events, ts)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    out = df.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def viral_velocity(reactions: DataFrame, post: str, ts: str = "ts", size: str = "2 seconds", viral: int = 15, rising: int = 5, late: str = "10 seconds") -> DataFrame:
    """Reactions of a post in a window: more than ``viral`` is viral, more than ``rising`` rising; others aren't reported."""
    df = event_time(reactions, ts)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    counts = df.groupBy(F.window(ts, size).alias("w"), post).agg(F.count("*").alias("n")).where(F.col("n") > rising)
    return counts.select(F.col("w.start").alias("window_start"), post, "n", F.when(F.col("n") > viral, "viral").otherwise("rising").alias("status"))


def keyword_route(posts: DataFrame, keywords: Sequence[str], topic: str | None = None, blocked: DataFrame | None = None, text: str = "text", user: str = "user", topic_column: str = "topic") -> DataFrame:
    """Posts that hold a keyword, as written, anywhere in the text, or are of a topic; those of blocked users are dropped first."""
    if blocked is not None:
        posts = posts.join(blocked.select(F.col(blocked.columns[0]).alias(user)).distinct(), user, "left_anti")
    hit = F.lit(False)
    for word in keywords:
        hit |= F.coalesce(F.contains(F.col(text), F.lit(word)), F.lit(False))
    if topic is not None:
        hit |= F.coalesce(F.col(topic_column) == topic, F.lit(False))
    return posts.where(hit)


def frame_latency_gate(frames: DataFrame, most_ms: float = 33.0) -> DataFrame:
    """Frames whose delay and computing time stay within a limit, with the overlay's place: the nose tip, 5 higher."""
    lag = F.col("arrival_ms") - F.col("event_ms") + F.col("compute_ms")
    nose = F.col("landmarks")["nose_tip"]
    return frames.withColumn("lag_ms", lag).where(F.col("lag_ms") <= most_ms).withColumns({"overlay_x": nose[0], "overlay_y": nose[1] - 5})


# Playback sessions


def playback_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type", order: str = "event_id", buffering: int = 3) -> DataFrame:
    """Closed sessions (user, session, start, end, duration_s, bufferings, alerts) of a batch.

    A start opens a session, in place of one that is open; buffering counts while one is open, and from the third
    on each is an alert; an end closes it. Events outside sessions are ignored.
    """
    w = Window.partitionBy(user).orderBy(ts, order)
    numbered = events.withColumn("session", F.sum(F.when(F.col(kind) == "start", 1).otherwise(0)).over(w)).where("session > 0")
    inside = Window.partitionBy(user, "session").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    live = numbered.withColumn("_ended", F.coalesce(F.max(F.col(kind) == "end").over(inside), F.lit(False))).where("NOT _ended")
    by = live.groupBy(user, "session").agg(F.min(ts).alias("start"), F.max(F.when(F.col(kind) == "end", F.col(ts))).alias("end"), count_if(F.col(kind) == "buffering").alias("bufferings"))
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return by.where("end IS NOT NULL").select(user, "session", "start", "end", seconds.alias("duration_s"), "bufferings", F.greatest(F.lit(0), F.col("bufferings") - (buffering - 1)).alias("alerts"))


class PlaybackProcessor(StatefulProcessor):
    """The same on a stream: state is a user's open session; a session that stays idle for an hour of event time is forgotten."""

    IDLE_MS = 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_ms long, bufferings int, session int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        start, n, session = self.open.get() if self.open.exists() else (-1, 0, 0)
        out = []
        for ts, kind in zip(events.ts, events.event_type, strict=True):
            ms = int(ts.value // 1_000_000)
            if kind == "start":
                start, n, session = ms, 0, session + 1
            elif start >= 0 and kind == "buffering":
                n += 1
            elif start >= 0 and kind == "end":
                out.append((key[0], session, (ms - start) / 1000.0, n, max(0, n - 2)))
                start, n = -1, 0
        self.open.update((start, n, session))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if start >= 0:
            self.handle.registerTimer(int(events.ts.max().value // 1_000_000) + self.IDLE_MS)
        yield pd.DataFrame(out, columns=["user_id", "session", "duration_s", "bufferings", "alerts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            _, _, session = self.open.get()
            self.open.update((-1, 0, session))
        yield pd.DataFrame([], columns=["user_id", "session", "duration_s", "bufferings", "alerts"])

    def close(self) -> None:
        pass


def playback_stream(events: DataFrame) -> DataFrame:
    df = event_time(events).withWatermark("ts", "10 minutes").select("user_id", "ts", "event_id", "event_type")
    return df.groupBy("user_id").transformWithStateInPandas(
        PlaybackProcessor(), outputStructType="user_id long, session int, duration_s double, bufferings int, alerts int", outputMode="Append", timeMode="EventTime")


# Change data


def cdc_state(events: DataFrame, entity: str, ts: str, trips: Column, rating: Column, least_trips: int = 15, least_rating: float = 4.8) -> DataFrame:
    """Each entity's trips and rating after every event, 0 and 5.0 before any is known, and whether this event earns the bonus.

    ``trips`` and ``rating`` are null for events that don't set them. The bonus is earned once.
    """
    w = Window.partitionBy(entity).orderBy(*([ts] if isinstance(ts, str) else ts)).rowsBetween(Window.unboundedPreceding, 0)
    state = events.withColumns({"trips": F.coalesce(F.last(trips, True).over(w), F.lit(0)), "rating": F.coalesce(F.last(rating, True).over(w), F.lit(5.0))})
    ok = (F.col("trips") >= least_trips) & (F.col("rating") >= least_rating)
    return state.withColumn("_ok", ok.cast("int")).withColumn("earns_bonus", (F.col("_ok") == 1) & (F.sum("_ok").over(w) == 1)).drop("_ok")


class CdcProcessor(StatefulProcessor):
    """An entity's fields after each change, in the order of event time.

    State is a map of the changes that the watermark hasn't passed, by time and id; a map of the fields as of the last one
    it has; whether the bonus has been earned; and when the entity was last heard of. Changes that come out of order
    within the watermark take their places. After ``idle_ms`` of event time without a change all state goes, and the
    entity begins anew.
    """

    COLUMNS = ("user_id", "ts", "event_id", "trips", "rating", "earns_bonus")

    def __init__(self, least_trips: int, least_rating: float, idle_ms: int):
        self.least_trips, self.least_rating, self.idle_ms = least_trips, least_rating, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "trips int, rating double")
        self.fields = handle.getMapState("fields", "name string", "value double")
        self.earned = handle.getValueState("earned", "at_us long")
        self.heard = handle.getValueState("heard", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = frame.ts.astype("datetime64[us]").astype("int64")
            for us, event, trips, rating in zip(times, frame.event_id, frame.trips, frame.rating, strict=True):
                self.waiting.updateValue((int(us), int(event)), (None if pd.isna(trips) else int(trips), None if pd.isna(rating) else float(rating)))
            for ms in {-(-int(us) // 1000) for us in times}:
                self.handle.registerTimer(ms)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = list(self.waiting.iterator())
        ready = sorted((at, change) for at, change in waiting if at[0] <= now * 1000)
        state = {"trips": 0.0, "rating": 5.0} | {name[0]: value[0] for name, value in self.fields.iterator()} if ready else {}
        for (us, event), change in ready:
            for name, value in zip(("trips", "rating"), change, strict=True):
                if value is not None:
                    state[name] = float(value)
                    self.fields.updateValue((name,), (state[name],))
            earns = state["trips"] >= self.least_trips and state["rating"] >= self.least_rating and not self.earned.exists()
            if earns:
                self.earned.update((us,))
            out.append((key[0], pd.Timestamp(us, unit="us"), event, int(state["trips"]), state["rating"], earns))
            self.waiting.removeKey((us, event))
        if ready:
            last = ready[-1][0][0]
            self.heard.update((last,))
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        elif len(waiting) == 0 and self.heard.exists() and self.heard.get()[0] // 1000 + self.idle_ms <= now:
            for held in (self.fields, self.earned, self.heard):
                held.clear()
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.COLUMNS).astype({"ts": "datetime64[us]", "earns_bonus": bool})

    def close(self) -> None:
        pass


def cdc_stream(events: DataFrame, trips: Column, rating: Column, least_trips: int = 15, least_rating: float = 4.8, late: str = "10 minutes", idle_days: int = 30) -> DataFrame:
    """``cdc_state`` of a stream of (user_id, ts, event_id, ...): a row for each change once the watermark has passed it.

    Changes later than the watermark are dropped. Rows that share an entity, a time and an id are one change, the last to come.
    """
    df = event_time(events).withWatermark("ts", late).select("user_id", "ts", "event_id", trips.cast("int").alias("trips"), rating.cast("double").alias("rating"))
    return df.groupBy("user_id").transformWithStateInPandas(
        CdcProcessor(least_trips, least_rating, idle_days * 86_400_000), outputStructType="user_id long, ts timestamp, event_id long, trips int, rating double, earns_bonus boolean", outputMode="Append", timeMode="EventTime")


# Alerts and ingest


class CooldownProcessor(StatefulProcessor):
    """Alerts with a cooldown in event time: state is the time of a machine's last alert."""

    def __init__(self, minutes: int = 15):
        self.wait_ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "score"])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, score, name in zip(events.ts, events.score, events.severity, strict=True):
            ms = int(ts.value // 1_000_000)
            if name == "CRITICAL" or last is None or ms - last >= self.wait_ms:
                last = ms
                out.append((key[0], ts, score, name))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["machine", "ts", "score", "severity"])

    def close(self) -> None:
        pass


def alert_stream(scored: DataFrame, minutes: int = 15) -> DataFrame:
    """Rows (machine, ts, score) of a stream as alerts."""
    named = event_time(scored).select("machine", "ts", "score", severity(F.col("score")).alias("severity")).where("severity IS NOT NULL")
    return named.withWatermark("ts", "10 minutes").groupBy("machine").transformWithStateInPandas(
        CooldownProcessor(minutes), outputStructType="machine string, ts timestamp, score double, severity string", outputMode="Append", timeMode="None")


def validated_stream(events: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[float, float]], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Known readings in bounds, once for each key within the watermark; counters come with each batch's progress."""
    ok = _known_and_within(bounds, ts)
    seen = event_time(events, ts).observe("ingest", F.count("*").alias("rows_read"), count_if(ok).alias("rows_valid"))
    return seen.where(ok).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet"):
    """Start a query that takes all there is and stops; files and checkpoint together write each row once."""
    return df.writeStream.format(kind).option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start()


def to_console(df: DataFrame, mode: str = "update", kind: str = "console", name: str | None = None):
    """Start a query that prints each batch's changed rows; ``kind`` memory keeps them in a table called ``name`` instead."""
    writer = df.writeStream.format(kind).outputMode(mode).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


class IngestCounters(StreamingQueryListener):
    """Keeps the counters that queries observe: a row for each query and batch, under ``path``.

    A query that starts again from its checkpoint keeps its id and goes on with its batches, and a batch that runs again
    writes its row again, so sums over the table count each batch once. A batch that was committed by a driver that died
    before it heard of it has no row.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "ingest"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            values = found.asDict()
            row = self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} long" for c in values))
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={event.progress.id}/batch={event.progress.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ingest_totals(spark: SparkSession, path: str) -> DataFrame:
    """Rows (query, batches, rows_read, rows_valid) of all that the counters' table has."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("query").agg(F.count("*").alias("batches"), F.sum("rows_read").alias("rows_read"), F.sum("rows_valid").alias("rows_valid"))


def ingest_counts(events: DataFrame, bounds: Mapping[str, tuple[float, float]], ts: str = "ts") -> DataFrame:
    """The batch twin: one row (rows_read, rows_valid)."""
    return events.agg(F.count("*").alias("rows_read"), count_if(_known_and_within(bounds, ts)).alias("rows_valid"))


def _known_and_within(bounds: Mapping[str, tuple[float, float]], ts: str) -> Column:
    ok = F.col(ts).isNotNull()
    for c, (low, high) in bounds.items():
        ok &= F.coalesce(F.col(c).between(low, high), F.lit(False))
    return ok


def exactly_once(events: DataFrame, key: str, path: str, checkpoint: str, ts: str = "ts", late: str = "1 day"):
    return start(event_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key]), path, checkpoint)


def dispatch(pings: DataFrame, orders: DataFrame) -> DataFrame:
    """Nearest idle driver of each order by the latest pings."""
    return nearest_available(orders, latest_position(pings, "driver_id", "ts").where("status = 'IDLE'"))


def dispatch_stream(events: DataFrame, state_path: str, out_path: str, checkpoint: str):
    """One stream of pings and ready orders: each batch renews the table of latest pings, then serves its orders.

    The table is written under the batch's number and read from the one before, so a repeated batch gives the same.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        columns = ("driver_id", "ts", "lat", "lon", "status")
        pings = batch.where("kind = 'ping'").select(*columns)
        if n:
            pings = pings.unionByName(spark.read.schema(pings.schema).parquet(f"{state_path}/batch={n - 1}"))
        latest_position(pings, "driver_id", "ts").select(*columns).write.mode("overwrite").parquet(f"{state_path}/batch={n}")
        latest = spark.read.schema(pings.schema).parquet(f"{state_path}/batch={n}").where("status = 'IDLE'")
        nearest_available(batch.where("kind = 'order'").select("order_id", "lat", "lon"), latest).write.mode("overwrite").parquet(f"{out_path}/batch={n}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
