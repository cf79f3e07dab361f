"""T: streaming jobs run over what has landed and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.plans.registry import register
from tillstream.plans.sources_q import _scratch
from tillstream.streaming import jobs


def _events(t):
    raw = jobs.read_landing(t.spark, t.sf_dir, t("events").schema, glob="events.parquet")
    return raw.select(F.col("user_id").alias("store"), F.col("event_type").alias("product"),
                      F.col("ts").alias("check_ts"), F.lit(1.0).alias("qty"), F.col("value").alias("amount"))


@register("t01_hourly_stream", "store:i product:s date:d hour:i qty:f amount:f n_lines:i", """
SELECT user_id AS store, event_type AS product, CAST(ts AS DATE) AS date, hour(ts) AS hour, CAST(count(*) AS DOUBLE) AS qty,
  sum(value) AS amount, count(*) AS n_lines FROM events GROUP BY 1, 2, 3, 4""")
def hourly_stream(t):
    df = jobs.hourly_windows(_events(t))
    out = jobs.run_update(df, _scratch(t.spark, "t01"), _scratch(t.spark, "t01-ckpt"), ["store", "product", "window_start"])
    return out.withColumns({"date": F.to_date("window_start"), "hour": F.hour("window_start")})


@register("t01_daily_stream", "store:i product:s date:d qty:f amount:f2 n_lines:i", """
SELECT user_id AS store, event_type AS product, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS qty,
  sum(value) AS amount, count(*) AS n_lines FROM events GROUP BY 1, 2, 3""")
def daily_stream(t):
    df = jobs.hourly_windows(_events(t), size="1 day")
    out = jobs.run_update(df, _scratch(t.spark, "t01d"), _scratch(t.spark, "t01d-ckpt"), ["store", "product", "window_start"])
    return out.withColumn("date", F.to_date("window_start"))


_HISTORY_DAYS = 15


@register("t02_drift_stream", "product:s window_start:d n_recent:i recent_mean:f6 hist_mean:f6 drift_ratio:f6 is_drift:i", f"""
WITH e AS (SELECT event_type AS product, ts, value FROM events WHERE event_type IS NOT NULL),
h AS (SELECT product, avg(value) AS hist_mean, stddev_samp(value) AS hist_std FROM e
      WHERE CAST(ts AS DATE) < (SELECT min(CAST(ts AS DATE)) FROM e) + {_HISTORY_DAYS} GROUP BY product),
w AS (SELECT product, CAST(ts AS DATE) - CAST(k AS INT) AS window_start, value FROM e, (SELECT unnest(range(7)) AS k)),
g AS (SELECT product, window_start, count(*) AS n_recent, avg(value) AS recent_mean FROM w
      WHERE window_start + 7 <= (SELECT max(ts) FROM e) - INTERVAL 1 DAY GROUP BY product, window_start)
SELECT g.*, hist_mean, abs(recent_mean - hist_mean) / (hist_std + 1e-8) AS drift_ratio,
  CAST(n_recent >= 10 AND abs(recent_mean - hist_mean) / (hist_std + 1e-8) > 2 AS INT) AS is_drift
FROM g LEFT JOIN h USING (product)""")
def drift_stream(t):
    """Closed windows against a history table that every micro-batch reads anew."""
    known = t("events").filter("event_type IS NOT NULL").select(F.col("event_type").alias("product"), "ts", "value")
    first = known.agg(F.min(F.to_date("ts"))).scalar()
    history = _scratch(t.spark, "t02-history")
    (known.filter(F.to_date("ts") < F.date_add(first, _HISTORY_DAYS)).groupBy("product")
          .agg(F.avg("value").alias("hist_mean"), F.stddev_samp("value").alias("hist_std")).write.parquet(history))
    raw = jobs.read_landing(t.spark, t.sf_dir, t("events").schema, glob="events.parquet").filter("event_type IS NOT NULL")
    log = raw.select(F.col("event_type").alias("product"), F.col("ts").alias("timestamp"), F.col("value").alias("prediction"))
    path = _scratch(t.spark, "t02")
    jobs.finish(jobs.start_drift(log, history, path, _scratch(t.spark, "t02-ckpt"), ["product"]))
    return t.spark.read.parquet(path)


_QUIET, _MIN_DAYS = 3, 3


@register("t03_early_stop_alerts", "store:i product:s date:d kind:s alert_at:s last_hour:i sold:f usual_hour:i", f"""
WITH e AS (SELECT user_id AS store, event_type AS product, ts, date_trunc('minute', ts) AS minute, CAST(ts AS DATE) AS date
           FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
wm AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM e),
d AS (SELECT store, product, date, max(hour(ts)) AS last_hour, CAST(count(*) AS DOUBLE) AS sold FROM e GROUP BY store, product, date),
u AS (SELECT *, CASE WHEN count(*) OVER p >= {_MIN_DAYS} THEN sum(last_hour) OVER p // count(*) OVER p END AS usual_hour
      FROM d WINDOW p AS (PARTITION BY store, product ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT store, product, date, minute, count(*) AS n FROM e GROUP BY store, product, date, minute),
g AS (SELECT *, lead(minute) OVER q AS nxt, CAST(sum(n) OVER q AS DOUBLE) AS sold, minute + INTERVAL {_QUIET} HOUR AS due
      FROM m WINDOW q AS (PARTITION BY store, product, date ORDER BY minute)),
a AS (SELECT store, product, u.date, 'close' AS kind, CAST(u.date + 1 AS TIMESTAMP) AS alert_at, last_hour, sold, usual_hour FROM u
      UNION ALL
      SELECT g.store, g.product, g.date, 'open', due, hour(minute), g.sold, usual_hour FROM g JOIN u USING (store, product, date)
      WHERE (nxt IS NULL OR nxt > due) AND due < g.date + 1 AND hour(minute) < usual_hour)
SELECT store, product, date, kind, strftime(alert_at, '%Y-%m-%d %H:%M') AS alert_at, last_hour, sold, usual_hour FROM a, wm WHERE alert_at <= w""")
def early_stop_alerts(t):
    """Each alert once, in append mode."""
    path = _scratch(t.spark, "t03a")
    jobs.finish(jobs.start_append(jobs.early_stop_alerts(_events(t), quiet_hours=_QUIET, min_days=_MIN_DAYS), path, _scratch(t.spark, "t03a-ckpt")))
    return t.spark.read.parquet(path).withColumn("alert_at", F.date_format("alert_at", "yyyy-MM-dd HH:mm"))


@register("t03_early_stop_stream", "store:i product:s date:d last_hour:i sold:f is_early_stop:i", """
SELECT user_id AS store, event_type AS product, CAST(ts AS DATE) AS date, max(hour(ts)) AS last_hour, CAST(count(*) AS DOUBLE) AS sold,
  CAST(max(hour(ts)) <= 14 AS INT) AS is_early_stop FROM events GROUP BY 1, 2, 3""")
def early_stop_stream(t):
    df = jobs.last_sale_windows(_events(t))
    return jobs.run_update(df, _scratch(t.spark, "t03"), _scratch(t.spark, "t03-ckpt"), ["store", "product", "date"])
