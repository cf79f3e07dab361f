"""D: restored demand, profiles, shares, baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillstream.operators import demand as dem, joins, series
from tillstream.plans.oracle_base import add_base
from tillstream.plans.registry import register
from tillstream.sources import sinks
from tillstream.sources.testdata import daily_fine, hourly, sale_events, sales, stock_daily

_KEYS = "store:i product:s date:d"

add_base("stop_days", """
SELECT store, product, date, sum(qty) AS sold, max(hour) AS last_hour, substr(product, 1, 1) AS category
FROM hourly GROUP BY store, product, date""")
add_base("full_shares", """
SELECT h.store, h.product, h.date, h.hour, s.category,
  sum(h.qty) OVER (PARTITION BY h.store, h.product, h.date ORDER BY h.hour) / s.sold AS cum_share
FROM hourly h JOIN stop_days s ON h.store = s.store AND h.product = s.product AND h.date = s.date
WHERE s.last_hour >= 17""")


def profile_sql(keys: str, src: str = "full_shares", until: str = "23") -> str:
    """Filled profile over `keys` (comma list) from `src`."""
    k = [x for x in keys.split(",") if x]
    on = " AND ".join(f"p.{x} = e.{x}" for x in k) or "TRUE"
    cols = ", ".join(k) + (", " if k else "")
    pcols = ", ".join(f"p.{x}" for x in k) + (", " if k else "")
    part = f"PARTITION BY {', '.join(k)} " if k else ""
    group = f"GROUP BY {', '.join(k)} " if k else ""
    days = f"(SELECT {cols}count(DISTINCT (store, product, date)) AS d FROM {src} {group} HAVING count(DISTINCT (store, product, date)) >= 5)"
    return f"""
SELECT {cols}unnest(range(hour, nxt)) AS hour, cum_share FROM (
  SELECT *, coalesce(lead(hour) OVER ({part}ORDER BY hour), {until} + 1) AS nxt FROM (
    SELECT {pcols}p.hour, floor(avg(p.cum_share) * 1e6 + 0.5e0) / 1e6 AS cum_share
    FROM {src} p JOIN {days} e ON {on} GROUP BY {pcols}p.hour))"""


add_base("profiles", profile_sql("store,product"))
RESTORE_SQL = """
  floor((CASE WHEN adj THEN greatest(sold, least(sold / cum_at_stop, sold * 5)) ELSE sold END) * 100 + 0.5e0) / 100 AS demand_estimated,
  floor((CASE WHEN adj THEN greatest(sold, least(sold / cum_at_stop, sold * 5)) - sold ELSE 0 END) * 100 + 0.5e0) / 100 AS lost_qty,
  CAST(adj AS INT) AS is_censored"""
add_base("restored", f"""
SELECT *, {RESTORE_SQL} FROM (
  SELECT s.*, p.cum_share AS cum_at_stop, p.cum_share IS NOT NULL AND last_hour < 17 AND p.cum_share >= 0.05e0 AS adj
  FROM stop_days s LEFT JOIN profiles p ON s.store = p.store AND s.product = p.product AND s.last_hour = p.hour)""")
add_base("demand_daily", """
SELECT store, product, category, date, sold, demand_estimated AS demand, lost_qty, is_censored FROM restored""")


def hourly_cat(t):
    return hourly(t).withColumn("category", F.substring("product", 1, 1))


def restored(t):
    h = hourly_cat(t)
    return dem.estimate_demand(h, dem.build_profiles(h))


def event_daily(t):
    return hourly_cat(t).groupBy("store", "product", "category", "date").agg(F.sum("qty").alias("sold"))


def demand_daily(t):
    return dem.attach_demand(event_daily(t), restored(t))


@register("d01_full_days", f"{_KEYS} last_hour:i sold:f", """
SELECT store, product, date, last_hour, sold FROM stop_days WHERE last_hour >= 17""")
def full_days(t):
    return dem.full_days(hourly(t))


@register("d02_profiles", "store:i product:s hour:i cum_share:f6", "SELECT * FROM profiles")
def profiles(t):
    return dem.build_profiles(hourly(t))


@register("d02_profiles_monotone", "store:i product:s hour:i cum_share:f6", """
SELECT store, product, hour, max(cum_share) OVER (PARTITION BY store, product ORDER BY hour) AS cum_share FROM profiles""")
def profiles_monotone(t):
    return dem.build_profiles(hourly(t), monotone=True)


@register("s08_profile_store", "store:i product:s hour:i cum_share:f6", "SELECT * FROM profiles")
def profile_store(t):
    from tillstream.plans.sources_q import _scratch
    path = _scratch(t.spark, "profiles")
    sinks.write_profiles(dem.build_profiles(hourly(t)), path)
    return sinks.unnest_profiles(sinks.nested_profiles(t.spark.read.parquet(path)))


@register("j03_lookup_profile", f"{_KEYS} last_hour:i cum_at_stop:f6", """
SELECT s.store, s.product, s.date, s.last_hour, p.cum_share AS cum_at_stop FROM stop_days s
LEFT JOIN profiles p ON s.store = p.store AND s.product = p.product AND s.last_hour = p.hour""")
def lookup_profile(t):
    return joins.lookup_profile(dem.stop_days(hourly(t)), dem.build_profiles(hourly(t)))


@register("d03_estimate_demand", f"{_KEYS} sold:f last_hour:i demand_estimated:f lost_qty:f is_censored:i", "SELECT * FROM restored")
def estimate_demand(t):
    return restored(t)


_P = "PARTITION BY store, product ORDER BY date"


# Hours of two kinds of series: users' events, and the dense series of a store and part type, long enough for a lag of
# 30 rows. Check lines have no time of day; it follows from check and part by fixed arithmetic, 8 to 21 o'clock.
add_base("till_hours", """
SELECT store, product, date, hour, qty FROM hourly WHERE store IS NOT NULL AND product IS NOT NULL AND hour IS NOT NULL
UNION ALL
SELECT s.store, s.category, s.date, 8 + (coalesce(s.check_id, 0) + s.part) % 14 AS hour, sum(s.qty) FROM sales s
WHERE s.category IS NOT NULL AND s.date IS NOT NULL
GROUP BY s.store, s.category, s.date, 8 + (coalesce(s.check_id, 0) + s.part) % 14""")
add_base("sold_daily", """
SELECT store, product, date, sum(qty) AS sold, max(hour) AS last_hour FROM till_hours GROUP BY store, product, date""")
add_base("sold_shares", """
SELECT h.store, h.product, h.date, h.hour,
  sum(h.qty) OVER (PARTITION BY h.store, h.product, h.date ORDER BY h.hour) / d.sold AS cum_share
FROM till_hours h JOIN sold_daily d ON h.store = d.store AND h.product = d.product AND h.date = d.date WHERE d.last_hour >= 17""")
add_base("sold_profiles", profile_sql("store,product", "sold_shares"))
add_base("sold_estimates", f"""
SELECT *, {RESTORE_SQL} FROM (
  SELECT d.*, p.cum_share AS cum_at_stop, p.cum_share IS NOT NULL AND last_hour < 17 AND p.cum_share >= 0.05e0 AS adj
  FROM sold_daily d LEFT JOIN sold_profiles p ON d.store = p.store AND d.product = p.product AND d.last_hour = p.hour)""")


def till_hours(t):
    """The hourly mart of users' events and of the sales of a store and part type."""
    hour = (8 + (F.coalesce("check_id", F.lit(0)) + F.col("part")) % 14).cast("int")
    lines = sales(t).filter("category IS NOT NULL AND date IS NOT NULL").groupBy(
        "store", F.col("category").alias("product"), "date", hour.alias("hour")).agg(F.sum("qty").alias("qty"))
    return hourly(t).select("store", "product", "date", "hour", "qty").unionByName(lines)


def sold_daily(t):
    return till_hours(t).groupBy("store", "product", "date").agg(F.sum("qty").alias("sold"))


def sold_estimates(t):
    """Demand restored from the profile of each pair at the hour of its last sale."""
    h = till_hours(t)
    return dem.estimate_demand(h, dem.build_profiles(h))


_D04 = [f"demand_lag{k}" for k in series.LAGS] + [f"demand_roll_mean{k}" for k in series.WINDOWS] + ["demand_roll_std7"]


def series_sql(col: str, prefix: str) -> str:
    """Lags, rolling means (half the window at least) and the 7-row deviation, over `p` in date order."""
    frame = "(p ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    lags = [f"lag({col}, {k}) OVER p AS {prefix}_lag{k}" for k in series.LAGS]
    means = [f"CASE WHEN count({col}) OVER {frame.format(k)} >= {max(1, k // 2)} THEN avg({col}) OVER {frame.format(k)} END AS {prefix}_roll_mean{k}"
             for k in series.WINDOWS]
    std = f"CASE WHEN count({col}) OVER {frame.format(7)} >= 2 THEN stddev_samp({col}) OVER {frame.format(7)} END AS {prefix}_roll_std7"
    return ", ".join([*lags, *means, std])


@register("d04_attach_demand", f"{_KEYS} demand:f lost_qty:f is_censored:i " + " ".join(f"{c}:f" for c in _D04), f"""
WITH attached AS (
  SELECT d.store, d.product, d.date, coalesce(e.demand_estimated, d.sold) AS demand, coalesce(e.lost_qty, 0) AS lost_qty, coalesce(e.is_censored, 0) AS is_censored
  FROM sold_daily d LEFT JOIN sold_estimates e ON d.store = e.store AND d.product = e.product AND d.date = e.date)
SELECT * FROM (SELECT *, {series_sql("demand", "demand")} FROM attached WINDOW p AS (PARTITION BY store, product ORDER BY date))
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _D04)}""")
def attach_demand(t):
    df = dem.attach_demand(sold_daily(t), sold_estimates(t)).transform(series.add_series_features, "demand", "demand")
    return df.dropna(subset=series.feature_columns(df, ["demand"]))


_UP = """count(*) AS n_rows, avg(sold) AS mean_sold, avg(demand) AS mean_demand,
  coalesce((avg(demand) - avg(sold)) * 100 / nullif(avg(sold), 0), 0) AS uplift_pct, avg(lost_qty) AS mean_lost,
  avg(is_censored) * 100 AS censored_pct, count(*) FILTER (demand > sold) AS n_raised FROM demand_daily"""
_UP_SPEC = "n_rows:i mean_sold:f mean_demand:f uplift_pct:f mean_lost:f censored_pct:f n_raised:i"


@register("d05_uplift", _UP_SPEC, f"SELECT {_UP}")
def uplift(t):
    return dem.uplift_report(demand_daily(t))


@register("d05_uplift_by_category", f"category:s {_UP_SPEC}", f"SELECT category, {_UP} GROUP BY category")
def uplift_by_category(t):
    return dem.uplift_report(demand_daily(t), "category")


_LOST = """WITH pr AS (SELECT event_type AS product, avg(value) AS avg_price FROM events GROUP BY event_type)
SELECT {k}, count(*) AS n_days, avg(last_hour) AS avg_stop_hour, avg(sold) AS avg_sold, avg(demand_estimated) AS avg_estimated,
  avg(lost_qty) AS avg_lost, sum(lost_qty) AS total_lost, sum(lost_qty * avg_price) AS total_lost_revenue,
  avg(cum_at_stop) AS avg_cum_at_stop, avg(demand_estimated) / avg(sold) AS avg_multiplier
FROM restored JOIN pr USING (product) WHERE is_censored = 1 GROUP BY {k}"""
_LOST_SPEC = "n_days:i avg_stop_hour:f avg_sold:f avg_estimated:f avg_lost:f total_lost:f2 total_lost_revenue:f2 avg_cum_at_stop:f avg_multiplier:f"


def _prices(t):
    return t("events").groupBy(F.col("event_type").alias("product")).agg(F.avg("value").alias("avg_price"))


@register("d06_lost_revenue_by_product", f"product:s {_LOST_SPEC}", _LOST.format(k="product"))
def lost_by_product(t):
    return dem.lost_revenue(restored(t), _prices(t), "product")


@register("d06_lost_revenue_by_stop_hour", f"last_hour:i {_LOST_SPEC}", _LOST.format(k="last_hour"))
def lost_by_hour(t):
    return dem.lost_revenue(restored(t), _prices(t), "last_hour")


@register("d07_hierarchical_fallback", f"{_KEYS} last_hour:i level:s demand_estimated:f lost_qty:f is_censored:i", f"""
WITH pp AS ({profile_sql('product')}), pc AS ({profile_sql('category')}), ps AS ({profile_sql('store')}), pg AS ({profile_sql('')}),
x AS (SELECT s.*, coalesce(a.cum_share, b.cum_share, c.cum_share, d.cum_share, g.cum_share) AS cum_at_stop,
  CASE WHEN a.cum_share IS NOT NULL THEN 'pair' WHEN b.cum_share IS NOT NULL THEN 'product' WHEN c.cum_share IS NOT NULL THEN 'category'
       WHEN d.cum_share IS NOT NULL THEN 'store' WHEN g.cum_share IS NOT NULL THEN 'global' ELSE 'none' END AS level
  FROM stop_days s LEFT JOIN profiles a ON a.store = s.store AND a.product = s.product AND a.hour = last_hour
  LEFT JOIN pp b ON b.product = s.product AND b.hour = last_hour LEFT JOIN pc c ON c.category = s.category AND c.hour = last_hour
  LEFT JOIN ps d ON d.store = s.store AND d.hour = last_hour LEFT JOIN pg g ON g.hour = last_hour)
SELECT *, {RESTORE_SQL} FROM (SELECT *, cum_at_stop IS NOT NULL AND last_hour < 17 AND cum_at_stop >= 0.05e0 AS adj FROM x)""")
def hierarchical_fallback(t):
    return dem.estimate_with_fallback(hourly_cat(t))


@register("d08_segment_profiles", "store:i product:s segment:s hour:i cum_share:f6", f"""
WITH seg AS (SELECT *, CASE WHEN isodow(date) > 5 THEN 'weekend' ELSE 'weekday' END AS segment FROM full_shares)
{profile_sql('store,product,segment', 'seg')}""")
def segment_profiles(t):
    return dem.build_profiles(dem.with_segment(hourly(t)), ("store", "product", "segment"))


add_base("store_hours", "SELECT store, date, hour, sum(qty) AS store_qty FROM hourly GROUP BY store, date, hour")
add_base("pair_hours", """
SELECT s.store, p.product, s.date, s.hour, s.store_qty, coalesce(h.qty, 0) AS qty, coalesce(h.qty, 0) / s.store_qty AS share
FROM store_hours s JOIN (SELECT DISTINCT store, product FROM hourly) p ON s.store = p.store
LEFT JOIN hourly h ON h.store = s.store AND h.product = p.product AND h.date = s.date AND h.hour = s.hour""")
add_base("share_profiles", """
SELECT *, CASE WHEN hour BETWEEN 7 AND 20 THEN greatest(avg_share, median(CASE WHEN hour BETWEEN 7 AND 20 THEN avg_share END)
          OVER (PARTITION BY store, product)) END AS avg_share_day
FROM (SELECT store, product, hour, count(*) AS n_obs, avg(share) AS avg_share,
             coalesce(avg(CASE WHEN qty > 0 THEN share END), 0) AS avg_share_sold FROM pair_hours GROUP BY store, product, hour)""")


@register("d09_share_expectation", f"{_KEYS} store_qty:f actual:f expected:f8 gap:f8 abs_gap:f8 wmape:f8", """
SELECT store, product, date, sum(store_qty) AS store_qty, sum(qty) AS actual, sum(store_qty * avg_share) AS expected,
  sum(store_qty * avg_share) - sum(qty) AS gap, sum(abs(store_qty * avg_share - qty)) AS abs_gap,
  CASE WHEN sum(qty) > 0 THEN sum(abs(store_qty * avg_share - qty)) / sum(qty) END AS wmape
FROM pair_hours JOIN share_profiles USING (store, product, hour) GROUP BY store, product, date""")
def share_expectation(t):
    return dem.share_expectations(hourly(t))


@register("d10_hour_share_profiles", "store:i product:s hour:i n_obs:i avg_share:f8 avg_share_sold:f8 avg_share_day:f8",
          "SELECT * FROM share_profiles")
def hour_share_profiles(t):
    return dem.hour_share_profiles(hourly(t))


@register("d10_hour_share_variants", f"{_KEYS} expected_sold_hours:f8 expected_day_hours:f8", """
SELECT store, product, date, sum(store_qty * avg_share_sold) AS expected_sold_hours,
  coalesce(sum(store_qty * avg_share_day), 0) AS expected_day_hours
FROM pair_hours JOIN share_profiles USING (store, product, hour) GROUP BY store, product, date""")
def hour_share_variants(t):
    return dem.share_expectations(hourly(t))


@register("d10_daily_share_variants", f"{_KEYS} share:f8 expected_daily:f8 expected_weekday:f8 expected_high:f8", """
WITH d AS (SELECT store, product, date, sum(qty) AS actual, sum(store_qty) AS store_qty, sum(qty) / sum(store_qty) AS share
           FROM pair_hours GROUP BY store, product, date),
c AS (SELECT *, avg(share) OVER w AS a, avg(share) OVER (PARTITION BY store, product, isodow(date)) AS wd,
      quantile_cont(share, 0.2) OVER w AS cut FROM d WINDOW w AS (PARTITION BY store, product))
SELECT store, product, date, share, store_qty * a AS expected_daily, store_qty * wd AS expected_weekday,
  CASE WHEN share > cut THEN store_qty * avg(CASE WHEN share > cut THEN share END) OVER (PARTITION BY store, product) END AS expected_high
FROM c""")
def daily_share_variants(t):
    return dem.daily_share_variants(hourly(t))


_HS = ", ".join(f"max(CASE WHEN hour = {h} THEN share END) AS h{h}" for h in range(24))


@register("d11_share_matrix", "store:i product:s " + " ".join(f"h{h}:f6" for h in range(24)), f"""
WITH p AS (SELECT store, product, hour, sum(qty) AS qty FROM hourly GROUP BY store, product, hour),
s AS (SELECT *, qty / sum(qty) OVER (PARTITION BY store, hour) AS share FROM p)
SELECT store, product, {_HS} FROM s GROUP BY store, product""")
def share_matrix(t):
    return dem.share_matrix(hourly(t))


add_base("pair_grid", """
SELECT d.store, d.product, d.date, h.hour, coalesce(x.qty, 0) AS qty, coalesce(s.store_qty, 0) AS traffic
FROM (SELECT DISTINCT store, product, date FROM hourly) d, (SELECT unnest(range(24)) AS hour) h
LEFT JOIN hourly x ON x.store = d.store AND x.product = d.product AND x.date = d.date AND x.hour = h.hour
LEFT JOIN store_hours s ON s.store = d.store AND s.date = d.date AND s.hour = h.hour""")
add_base("near_grid", """
SELECT *, CASE WHEN count(*) OVER w = 3 THEN sum(qty) OVER w ELSE 0 END AS near FROM pair_grid
WINDOW w AS (PARTITION BY store, product, date ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")


@register("d12_stockout_mask", f"{_KEYS} hour:i traffic:f near:f", """
SELECT * FROM near_grid WHERE qty = 0 AND traffic > 0 AND near > 0""")
def stockout_mask(t):
    return dem.stockout_mask(dem.pair_hour_grid(hourly(t))).filter(F.col("suspected") == 1)


@register("d13_advanced_mask", "store:i product:s hour:i n_days:i n_suspected:i n_strict:i", """
WITH m AS (SELECT *, median(CASE WHEN qty > 0 THEN qty END) OVER w AS usual, median(traffic) OVER w AS ut
           FROM near_grid WINDOW w AS (PARTITION BY store, product, hour)),
f AS (SELECT *, coalesce(qty < usual * 0.3e0 AND traffic >= ut * 0.5e0 AND near > 0, FALSE) AS s FROM m)
SELECT store, product, hour, count(*) AS n_days, count(*) FILTER (s) AS n_suspected, count(*) FILTER (s AND qty <= 1) AS n_strict
FROM f GROUP BY store, product, hour""")
def advanced_mask(t):
    m = dem.advanced_stockout_mask(dem.pair_hour_grid(hourly(t)))
    return m.groupBy("store", "product", "hour").agg(
        F.count("*").alias("n_days"), F.sum("suspected").alias("n_suspected"), F.sum("strict").alias("n_strict"))


# A strict mask holds counts of 0 and 1 only, for which the EM step has a closed form.
@register("d14_censored_rates", "store:i product:s hour:i n_days:i n_censored:i observed_rate:f rate:f", """
WITH RECURSIVE m AS (SELECT *, median(CASE WHEN qty > 0 THEN qty END) OVER w AS usual, median(traffic) OVER w AS ut
           FROM near_grid WINDOW w AS (PARTITION BY store, product, hour)),
f AS (SELECT *, coalesce(qty < usual * 0.3e0 AND traffic >= ut * 0.5e0 AND near > 0, FALSE) AND qty <= 1 AS c FROM m),
g AS (SELECT store, product, hour, count(*) AS n_days, count(*) FILTER (c) AS n_censored, sum(qty) / count(*) AS observed_rate,
  coalesce(sum(qty) FILTER (NOT c), 0) AS s, count(*) FILTER (c AND qty = 0) AS c0, count(*) FILTER (c AND qty = 1) AS c1
  FROM f GROUP BY store, product, hour),
em AS (SELECT *, greatest(observed_rate, 1e-6) AS rate, 0 AS step FROM g UNION ALL
  SELECT store, product, hour, n_days, n_censored, observed_rate, s, c0, c1,
    (s + c0 * rate + c1 * greatest(rate / greatest(1 - exp(-rate), 1e-12), 1)) / n_days, step + 1 FROM em WHERE step < 25)
SELECT * FROM em WHERE step = 25""")
def censored_rates(t):
    return dem.censored_rates(dem.advanced_stockout_mask(dem.pair_hour_grid(hourly(t))))


# ln P(X >= 1) = ln(1 - exp(-rate)) is all that a strict mask needs; halvings go from the same brackets.
_LL = "(CASE WHEN s > 0 THEN s * ln({r}) ELSE 0 END - n0 * {r} + CASE WHEN c1 > 0 THEN c1 * ln(1 - exp(-({r}))) ELSE 0 END)"
_MID = "({a} + {w} * pow(0.5e0, step + 1))"


def _mid(at: str, width: str) -> str:
    return _MID.format(a=at, w=width)


@register("d14_rate_interval", "store:i product:s hour:i n_days:i n_censored:i rate:f rate_low:f rate_high:f", f"""
WITH RECURSIVE m AS (SELECT *, median(CASE WHEN qty > 0 THEN qty END) OVER w AS usual, median(traffic) OVER w AS ut
           FROM near_grid WINDOW w AS (PARTITION BY store, product, hour)),
f AS (SELECT *, coalesce(qty < usual * 0.3e0 AND traffic >= ut * 0.5e0 AND near > 0, FALSE) AND qty <= 1 AS c FROM m),
g AS (SELECT store, product, hour, count(*) AS n_days, count(*) FILTER (c) AS n_censored, CAST(nullif(count(*) FILTER (NOT c), 0) AS DOUBLE) AS n0,
  CAST(coalesce(sum(qty) FILTER (NOT c), 0) AS DOUBLE) AS s, CAST(count(*) FILTER (c AND qty > 0) AS DOUBLE) AS c1 FROM f GROUP BY store, product, hour),
p AS (SELECT *, s / n0 AS lo, c1 / n0 AS wd, 0 AS step FROM g WHERE s + c1 > 0 UNION ALL
  SELECT store, product, hour, n_days, n_censored, n0, s, c1,
    CASE WHEN (s + CASE WHEN c1 > 0 THEN c1 * {_mid('lo', 'wd')} * exp(-{_mid('lo', 'wd')}) / (1 - exp(-{_mid('lo', 'wd')})) ELSE 0 END) / {_mid('lo', 'wd')} > n0
         THEN {_mid('lo', 'wd')} ELSE lo END, wd, step + 1 FROM p WHERE step < 50),
r AS (SELECT * EXCLUDE (lo, wd, step), lo AS rate, {_LL.format(r='lo')} - 1.3527717270e0 AS fl FROM p WHERE step = 50
  UNION ALL SELECT *, CASE WHEN n0 > 0 THEN 0e0 END, -1.3527717270e0 FROM g WHERE s + c1 = 0),
h AS (SELECT *, CASE WHEN n0 > 0 THEN 0e0 END AS rate_low, rate AS rate_high,
    greatest(rate, (CASE WHEN s > 0 THEN s * ln(2 * s / n0) - s ELSE 0 END - fl) * 2 / n0) - rate AS wd, 0 AS step FROM r UNION ALL
  SELECT store, product, hour, n_days, n_censored, n0, s, c1, rate, fl,
    CASE WHEN rate > 0 AND {_LL.format(r=_mid('rate_low', 'rate'))} < fl THEN {_mid('rate_low', 'rate')} ELSE rate_low END,
    CASE WHEN wd > 0 AND {_LL.format(r=_mid('rate_high', 'wd'))} > fl THEN {_mid('rate_high', 'wd')} ELSE rate_high END, wd, step + 1 FROM h WHERE step < 50)
SELECT * FROM h WHERE step = 50""")
def censored_rate_interval(t):
    """The strict mask over all hours, its rates with 90 % intervals."""
    return dem.censored_rate_interval(dem.advanced_stockout_mask(dem.pair_hour_grid(hourly(t))))


add_base("recent_profile", """
SELECT store, product, hour, floor(m / tot * 1e4 + 0.5e0) / 1e4 AS share FROM (
  SELECT *, sum(m) OVER (PARTITION BY store, product) AS tot FROM (
    SELECT store, product, hour, avg(qty) AS m FROM (
      SELECT *, max(dr) OVER (PARTITION BY store, product) AS n FROM (
        SELECT *, dense_rank() OVER (PARTITION BY store, product ORDER BY date DESC) AS dr FROM hourly) WHERE dr <= 30)
    WHERE n >= 7 GROUP BY store, product, hour)) WHERE hour BETWEEN 6 AND 22""")
add_base("stored_profile", """
SELECT store, product, hour, floor((cum_share - coalesce(lag(cum_share) OVER (PARTITION BY store, product ORDER BY hour), 0)) * 1e4 + 0.5e0) / 1e4 AS share
FROM profiles WHERE hour BETWEEN 6 AND 22""")
add_base("plan_shares", """
SELECT g.store, g.product, g.hour, g.source, coalesce(CASE source WHEN 'recent' THEN r.share WHEN 'stored' THEN s.share
  ELSE CASE WHEN g.hour BETWEEN 7 AND 21 THEN 0.0667e0 ELSE 0 END END, 0) AS share
FROM (SELECT store, product, unnest(range(6, 23)) AS hour, CASE WHEN (store, product) IN (SELECT (store, product) FROM recent_profile) THEN 'recent'
      WHEN (store, product) IN (SELECT (store, product) FROM stored_profile) THEN 'stored' ELSE 'even' END AS source
      FROM (SELECT DISTINCT store, product FROM hourly)) g
LEFT JOIN recent_profile r ON r.store = g.store AND r.product = g.product AND r.hour = g.hour
LEFT JOIN stored_profile s ON s.store = g.store AND s.product = g.product AND s.hour = g.hour""")


@register("d17_plan_shares", "store:i product:s hour:i source:s share:f", "SELECT * FROM plan_shares")
def plan_shares(t):
    h = hourly(t)
    return dem.hour_plan_shares(h, dem.build_profiles(h))


@register("d18_hourly_plan", f"{_KEYS} hour:i share:f planned:f actual:f", f"""
WITH f AS (SELECT store, product, date, coalesce(avg(sold) OVER ({_P} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
           (SELECT avg(sold) FROM stop_days)) AS forecast FROM stop_days)
SELECT f.store, f.product, f.date, p.hour, p.share, forecast * p.share AS planned, coalesce(h.qty, 0) AS actual
FROM f JOIN plan_shares p ON f.store = p.store AND f.product = p.product
LEFT JOIN hourly h ON h.store = f.store AND h.product = f.product AND h.date = f.date AND h.hour = p.hour""")
def hourly_plan(t):
    h = hourly(t)
    forecast = series.trailing_average(event_daily(t), "sold", 14, "forecast")
    return dem.hourly_plan(forecast, dem.hour_plan_shares(h, dem.build_profiles(h)), h)


_AFF = """
top AS (SELECT product FROM (SELECT product, sum(qty) AS q FROM sales GROUP BY product ORDER BY q DESC, product LIMIT 20)),
b AS (SELECT DISTINCT check_id, product FROM sales WHERE product IN (SELECT product FROM top)),
c AS (SELECT product, count(*) AS n FROM b GROUP BY product), tot AS (SELECT count(DISTINCT check_id) AS n FROM sales),
p AS (SELECT x.product AS item_a, y.product AS item_b, count(*) AS pair_count FROM b x JOIN b y
      ON x.check_id = y.check_id AND x.product < y.product GROUP BY x.product, y.product)"""


@register("d19_basket_affinity", "item_a:s item_b:s pair_count:i support:f6 lift:f", f"""
WITH {_AFF} SELECT item_a, item_b, pair_count, pair_count / tot.n::DOUBLE AS support,
  pair_count / tot.n::DOUBLE / ((ca.n / tot.n::DOUBLE) * (cb.n / tot.n::DOUBLE)) AS lift
FROM p JOIN c ca ON ca.product = item_a JOIN c cb ON cb.product = item_b, tot""")
def basket_affinity(t):
    return dem.basket_affinity(sales(t))


@register("d19_affinity_matrix", "item_a:s item_b:s pair_count:i", f"""
WITH {_AFF} SELECT item_a, item_b, pair_count FROM p UNION ALL SELECT item_b, item_a, pair_count FROM p""")
def affinity_matrix(t):
    return dem.affinity_matrix(dem.basket_affinity(sales(t)))


@register("d20_purchase_time_groups", "product:s avg_hour:f n_lines:i time_group:s", """
SELECT product, avg(hour) AS avg_hour, count(*) AS n_lines,
  CASE WHEN avg(hour) <= 10 THEN 'morning' WHEN avg(hour) <= 13 THEN 'lunch' ELSE 'afternoon' END AS time_group
FROM sale_events GROUP BY product""")
def purchase_time_groups(t):
    return dem.purchase_time_groups(sale_events(t))


def _stocked(rows):
    stock = (F.dayofyear("date") + F.col("store") * 7 + F.expr("cast(substring(product, 7) as int)")) % 4
    return dem.substitution_effect(rows.withColumn("stock", stock))


def _substitution(t):
    return _stocked(daily_fine(t))


def weekly_fine(t):
    """Region x week x category x brand: some tens of products meet, so five and more can be sold out."""
    regions = t("nation").select(F.col("n_nationkey").alias("store"), F.col("n_regionkey").alias("region"))
    week = F.to_date(F.date_trunc("week", "date")).alias("date")
    return sales(t).join(regions, "store").groupBy(week, F.col("region").alias("store"), "category", "product").agg(F.sum("qty").alias("sold"))


def _substitution_sql(rows: str) -> str:
    return f"""
SELECT *, sold - avg_sold AS delta, sold / (avg_sold + 0.1e0) AS ratio FROM (
  SELECT *, avg(sold) OVER (PARTITION BY store, product) AS avg_sold,
    sum(o) OVER (PARTITION BY store, date) - o AS others_out, sum(o) OVER (PARTITION BY store, date, category) - o AS others_out_category
  FROM (SELECT *, CAST(stock = 0 AS INT) AS o FROM (
    SELECT *, (dayofyear(date) + store * 7 + CAST(substr(product, 7) AS INT)) % 4 AS stock FROM {rows}))) WHERE stock > 0"""


add_base("weekly_fine", """
SELECT CAST(date_trunc('week', s.date) AS DATE) AS date, n_regionkey AS store, s.category, s.product, sum(s.qty) AS sold
FROM sales s JOIN nation ON s.store = n_nationkey GROUP BY CAST(date_trunc('week', s.date) AS DATE), n_regionkey, s.category, s.product""")
add_base("substitution", _substitution_sql("daily_fine"))
add_base("weekly_effect", _substitution_sql("weekly_fine"))
_SUB = "n_rows:i avg_sold:f avg_norm:f avg_delta:f avg_ratio:f"


@register("d21_substitution_buckets", f"bucket:s {_SUB}", """
SELECT CASE WHEN others_out <= 0 THEN '0' WHEN others_out <= 5 THEN '1-5' WHEN others_out <= 10 THEN '6-10'
  WHEN others_out <= 15 THEN '11-15' ELSE '16+' END AS bucket, count(*) AS n_rows, avg(sold) AS avg_sold, avg(avg_sold) AS avg_norm,
  avg(delta) AS avg_delta, avg(ratio) AS avg_ratio FROM substitution GROUP BY 1""")
def substitution_buckets(t):
    bounds = [(0, "0"), (5, "1-5"), (10, "6-10"), (15, "11-15")]
    return dem.substitution_buckets(_substitution(t), "others_out", bounds, "16+")


@register("d21_substitution_same_category", f"bucket:s {_SUB}", """
SELECT CASE WHEN others_out_category <= 0 THEN '0' WHEN others_out_category <= 2 THEN '1-2' WHEN others_out_category <= 5 THEN '3-5'
  ELSE '6+' END AS bucket, count(*) AS n_rows, avg(sold) AS avg_sold, avg(avg_sold) AS avg_norm,
  avg(delta) AS avg_delta, avg(ratio) AS avg_ratio FROM substitution GROUP BY 1""")
def substitution_same_category(t):
    bounds = [(0, "0"), (2, "1-2"), (5, "3-5")]
    return dem.substitution_buckets(_substitution(t), "others_out_category", bounds, "6+")


@register("d21_substitution_by_category", "category:s delta_none:f n_none:i delta_many:f n_many:i difference:f", """
SELECT category, avg(delta) FILTER (others_out <= 0) AS delta_none, count(*) FILTER (others_out <= 0) AS n_none,
  avg(delta) FILTER (others_out >= 5) AS delta_many, count(*) FILTER (others_out >= 5) AS n_many,
  coalesce(avg(delta) FILTER (others_out >= 5) - avg(delta) FILTER (others_out <= 0), 0) AS difference
FROM weekly_effect GROUP BY category""")
def substitution_by_category(t):
    return dem.substitution_by_category(_stocked(weekly_fine(t)))


_BY = (8, 10, 12, 14, 16, 18)


@register("d22_milestone_hours", "store:i product:s h50:i h80:i time_type:s " + " ".join(f"by_{h}:f" for h in _BY), """
WITH s AS (SELECT store, product, date, hour, qty / sum(qty) OVER (PARTITION BY store, product, date) AS share FROM hourly),
m AS (SELECT store, product, hour, avg(share) AS share FROM s GROUP BY store, product, hour),
c AS (SELECT *, sum(share) OVER (PARTITION BY store, product ORDER BY hour) AS cum FROM m),
h AS (SELECT store, product, min(hour) FILTER (cum >= 0.5e0 - 1e-9) AS h50, min(hour) FILTER (cum >= 0.8e0 - 1e-9) AS h80, """
          + ", ".join(f"coalesce(arg_max(cum, hour) FILTER (hour <= {h}), 0) AS by_{h}" for h in _BY) + """
FROM c GROUP BY store, product)
SELECT *, CASE WHEN h50 <= 10 THEN 'morning' WHEN h50 <= 12 THEN 'lunch' ELSE 'even' END AS time_type FROM h""")
def milestone_hours(t):
    return dem.milestone_hours(hourly(t), ("store", "product"))


@register("d23_two_stage", f"{_KEYS} p_censored:f loss_if_censored:f demand_two_stage:f", """
WITH s AS (SELECT store, category, avg(is_censored) AS p_censored, coalesce(avg(lost_qty) FILTER (is_censored = 1), 0) AS loss_if_censored
           FROM stock_daily GROUP BY store, category)
SELECT d.store, d.product, d.date, p_censored, loss_if_censored, sold + p_censored * loss_if_censored AS demand_two_stage
FROM stock_daily d JOIN s ON d.store = s.store AND d.category = s.category""")
def two_stage(t):
    return dem.two_stage_restoration(stock_daily(t), ("store", "category"))
