"""Structured Streaming jobs over till events.

State is one row per open window and key; the watermark closes windows and drops them.
Queries recover from their checkpoint folder. Append sinks are exactly-once through the
file sink's log. Update sinks write each epoch to its own partition, which a retry
replaces, and readers keep the latest epoch of a key.
"""

from __future__ import annotations

import bisect
import datetime
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Keeps window state on local disk instead of the executors' heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def read_landing(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Files dropped into a landing directory; the schema is fixed, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def hourly_windows(events: DataFrame, ts: str = "check_ts", late: str = "2 days", size: str = "1 hour") -> DataFrame:
    """Quantity, amount and lines per store, product and tumbling window."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (timed.groupBy(F.window(ts, size).alias("w"), "store", "product")
                 .agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.count("*").alias("n_lines"))
                 .select("store", "product", F.col("w.start").alias("window_start"), "qty", "amount", "n_lines"))


def prediction_windows(log: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp",
                       late: str = "1 day", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Number and mean of predictions per sliding window and key."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    per = timed.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(
        F.count("*").alias("n_recent"), F.avg("prediction").alias("recent_mean"))
    return per.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_recent", "recent_mean")


def with_drift(windows: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows joined with their key's history (hist_mean, hist_std); a key without history has no ratio and no drift."""
    joined = windows.join(history.select(*keys, "hist_mean", "hist_std"), list(keys), "left")
    ratio = F.abs(F.col("recent_mean") - F.col("hist_mean")) / (F.col("hist_std") + 1e-8)
    return joined.withColumn("drift_ratio", ratio).withColumn(
        "is_drift", F.coalesce((F.col("n_recent") >= 10) & (F.col("drift_ratio") > 2.0), F.lit(False)).cast("int"))


def start_drift(log: DataFrame, history: str, path: str, checkpoint: str, keys: Sequence[str], available_now: bool = True,
                **windows) -> StreamingQuery:
    """Closed windows joined with the history table, each written once.

    The table below `history` is listed again for every micro-batch, so figures that were replaced since
    the last one are used from the next one on. An epoch has its own partition, which a retry replaces.
    """
    _use_state_store(log.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        known = batch.sparkSession.read.parquet(history)
        epoch_writer(path)(with_drift(batch, known, keys), epoch)
    writer = (prediction_windows(log, keys, **windows).writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


MINUTE, DAY, NEVER = 60_000, 86_400_000, -1 << 62
ALERTS = "store {store}, product {product}, date date, kind string, alert_at timestamp, last_hour int, sold double, usual_hour int"
PAIRS = ("store array<{store}>, product array<{product}>, days array<long>, hours array<long>, "
         "minutes array<array<long>>, sold array<array<double>>, done long, timer long")


class EarlyStop(StatefulProcessor):
    """Alerts per (store, product) of a group of pairs, driven by event time.

    `open`: a pair that usually sells until a later hour has had no sale for `quiet_hours`, and its day is not over. Fired
    when the watermark passes that moment, so no sale that is in time can be missing. `close`: once per
    day with sales, when the watermark passes midnight, with the day's last hour. The usual hour is the mean
    last hour of the days closed before, rounded down, from `min_days` of them on.

    State of a pair is the minutes with sales of its open days (1,440 a day at most) and two numbers. A call to the state
    store is a round trip from Python, so the pairs of a group share one value and one timer, set to the first moment due in
    any of them: a batch costs a group a few calls, whatever its pairs, days and alerts. `done` is the last watermark at
    which the timer fired. What fell due by then has been seen; a row that is in time is later, and so is what it makes due.
    """

    def __init__(self, quiet_hours: int, min_days: int, state: str):
        self.quiet, self.min_days, self.state = quiet_hours * 60, min_days, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getValueState("pairs", self.state)

    def _load(self) -> tuple[dict[tuple, list], int, int | None]:
        """By pair the days closed, the sum of their last hours, the open minutes in order and what each sold; `done`; the timer."""
        store, product, *values, done, timer = self.pairs.get() or ((),) * 6 + (NEVER, None)
        return {(s, p): list(v) for s, p, *v in zip(store, product, *values)}, done, timer

    def _save(self, pairs: dict[tuple, list], done: int, timer: int | None) -> None:
        """`timer`: the one that is set and has not fired."""
        first = min((self._first_due(minutes, done) for _, _, minutes, _ in pairs.values() if minutes), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.pairs.update((*map(list, zip(*pairs)), *map(list, zip(*pairs.values())), done, first))

    def _first_due(self, minutes: list[int], done: int) -> int:
        """The end of the first day that is open, or of quiet hours after `done` if these end earlier."""
        midnight = _midnight(minutes[0])
        i = bisect.bisect_right(minutes, done // MINUTE - self.quiet)
        return midnight if i == len(minutes) else min(midnight, (minutes[i] + self.quiet) * MINUTE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pairs, done, timer = self._load()
        changed: dict[tuple, dict[int, float]] = {}
        for frame in rows:
            for store, product, at_ms, qty in zip(*(frame[c].tolist() for c in ("store", "product", "at_ms", "qty"))):
                pair = (store, product)
                if (sold := changed.get(pair)) is None:
                    sold = changed[pair] = dict(zip(*pairs.setdefault(pair, [0, 0, [], []])[2:]))
                minute = at_ms // MINUTE
                sold[minute] = sold.get(minute, 0.0) + qty
        for pair, sold in changed.items():
            order = sorted(sold)
            pairs[pair][2:] = order, [sold[m] for m in order]
        self._save(pairs, done, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pairs, done, _ = self._load()
        out = [alert for pair, of in pairs.items() for alert in self._alerts(pair, of, done, now)]
        self._save(pairs, now, None)
        if out:
            store, product, day, kind, at, hour, sold, usual = zip(*out)
            first = datetime.date(1970, 1, 1)
            yield pd.DataFrame({"store": store, "product": product, "date": [first + datetime.timedelta(days=d) for d in day], "kind": kind,
                                "alert_at": pd.to_datetime(at, unit="ms", utc=True), "last_hour": hour, "sold": sold,
                                "usual_hour": pd.array(usual, dtype="Int32")})

    def _alerts(self, pair: tuple, of: list, done: int, now: int) -> Iterator[tuple]:
        """What fell due after `done` and by `now`, in order of time; days that are over leave the pair."""
        minutes, sold = of[2:]
        start = 0
        while start < len(minutes):
            midnight = _midnight(minutes[start])
            day, end = midnight // DAY - 1, bisect.bisect_left(minutes, midnight // MINUTE, start)
            usual = of[1] // of[0] if of[0] >= self.min_days else None
            for i in range(start, end) if usual is not None else ():
                due, hour = (minutes[i] + self.quiet) * MINUTE, minutes[i] // 60 % 24
                quiet = i + 1 == end or minutes[i + 1] > minutes[i] + self.quiet
                if quiet and done < due <= now and due < midnight and hour < usual:
                    yield *pair, day, "open", due, hour, float(sum(sold[start:i + 1])), usual
            if midnight > now:
                break
            last = minutes[end - 1] // 60 % 24
            yield *pair, day, "close", midnight, last, float(sum(sold[start:end])), usual
            of[0], of[1], start = of[0] + 1, of[1] + last, end
        of[2:] = minutes[start:], sold[start:]


def _midnight(minute: int) -> int:
    """The end of a minute's day."""
    return (minute * MINUTE // DAY + 1) * DAY


def early_stop_alerts(events: DataFrame, ts: str = "check_ts", late: str = "2 hours", quiet_hours: int = 3, min_days: int = 3,
                      groups: int = 4096) -> DataFrame:
    """Stream of alerts, each once; see `EarlyStop`. Rows with a null key or time are left out; days are those of UTC.

    `groups`: how many groups the pairs are dealt into by hash; fixed for the life of a checkpoint.
    """
    timed = events.dropna(subset=["store", "product", ts]).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    types = dict(events.dtypes)
    keys = {"store": types["store"], "product": types["product"]}
    rows = timed.select(F.pmod(F.xxhash64("store", "product"), F.lit(groups)).cast("int").alias("part"), "store", "product", ts,
                        F.unix_millis(ts).alias("at_ms"), F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"))
    return rows.groupBy("part").transformWithStateInPandas(
        EarlyStop(quiet_hours, min_days, PAIRS.format(**keys)), ALERTS.format(**keys), "Append", "EventTime")


def last_sale_windows(events: DataFrame, ts: str = "check_ts", late: str = "2 hours", stop_hour: int = 14) -> DataFrame:
    """Last sale hour of every pair-day and whether it was early."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    per = timed.groupBy(F.window(ts, "1 day").alias("w"), "store", "product").agg(
        F.max(F.hour(ts)).alias("last_hour"), F.sum("qty").alias("sold"))
    return per.select("store", "product", F.to_date("w.start").alias("date"), "last_hour", "sold",
                      (F.col("last_hour") <= stop_hour).cast("int").alias("is_early_stop"))


def _use_state_store(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def start_append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Closed windows only, each written once."""
    _use_state_store(df.sparkSession)
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(path)


def epoch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes an epoch's changed rows to their own partition; a retried epoch replaces it."""
    def write(batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))
    return write


def start_update(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every changed window per epoch, open ones included."""
    _use_state_store(df.sparkSession)
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(epoch_writer(path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value of each window: its row from the latest epoch."""
    w = Window.partitionBy(*keys).orderBy(F.col("epoch").desc())
    return (spark.read.parquet(path).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn", "epoch"))


def finish(query: StreamingQuery) -> None:
    """Wait until what has landed is processed; a failed query raises."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_update(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Process what has landed so far, then read the current values."""
    finish(start_update(df, path, checkpoint))
    return latest_rows(df.sparkSession, path, keys)
