"""Restoring demand hidden by early sell-outs, hour profiles, shares and baskets.

Input is the hourly mart: one row per store, product, date and hour. A pair then holds
at most 24 rows per calendar day, which bounds every window below. The mart is spread
by pair once; the per-day windows and the per-hour means reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.functions.maths import ratio, round_half_up
from tillstream.operators.common import DATE, PAIR
from tillstream.operators.joins import salted_join
from tillstream.session import cut_lineage

# Fixed values of the restoration rule.
FULL_DAY_HOUR = 17
MIN_FULL_DAYS = 5
CUM_FLOOR = 0.05
MAX_MULTIPLIER = 5.0


def full_days(hourly: DataFrame, keys: Sequence[str] = PAIR, full_hour: int = FULL_DAY_HOUR) -> DataFrame:
    """Pair-days whose last sale is late enough to show the whole day's demand."""
    return (hourly.groupBy(*keys, DATE).agg(F.max("hour").alias("last_hour"), F.sum("qty").alias("sold"))
                  .filter(F.col("last_hour") >= full_hour))


def _full_day_shares(hourly: DataFrame, keys: Sequence[str], full_hour: int) -> DataFrame:
    """Hourly rows of full days with running share; `first_row` marks one row per day."""
    spread = hourly.repartition(*keys)  # one exchange serves all windows below
    day = Window.partitionBy(*keys, DATE)
    run = day.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return (spread.withColumn("last_hour", F.max("hour").over(day))
                  .filter(F.col("last_hour") >= full_hour)
                  .withColumns({"first_row": (F.row_number().over(day.orderBy("hour")) == 1).cast("int"),
                                "day_total": F.sum("qty").over(day),
                                "cum_qty": F.sum("qty").over(run)})
                  .withColumn("cum_share", ratio(F.col("cum_qty"), F.col("day_total"))))


def _fill_hours(points: DataFrame, keys: Sequence[str], col: str, until: int | None,
                monotone: bool) -> DataFrame:
    """Carry each hour's value to the hours before the next known one.

    `until` extends the last value; None stops at the last known hour. At most 24 rows a key.
    """
    w = Window.partitionBy(*keys).orderBy("hour") if keys else Window.orderBy("hour")
    if monotone:
        points = points.withColumn(col, F.max(col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.lead("hour").over(w) - 1
    last = F.coalesce(end, F.lit(until) if until is not None else F.col("hour"))
    upto = points.withColumn("_to", F.greatest(last, F.col("hour")))
    return upto.withColumn("hour", F.explode(F.sequence("hour", "_to"))).drop("_to")


def build_profiles(hourly: DataFrame, keys: Sequence[str] = PAIR, full_hour: int = FULL_DAY_HOUR,
                   min_days: int = MIN_FULL_DAYS, until: int | None = 23,
                   monotone: bool = False) -> DataFrame:
    """Mean running share per hour of pairs with enough full days.

    The mean of an hour covers only days with a sale in it, so it may dip; `monotone`
    takes the running maximum instead. Hours before the first known one stay absent.
    """
    shares = _full_day_shares(hourly, keys, full_hour)
    counted = shares.withColumn("_days", F.sum("first_row").over(Window.partitionBy(*keys)))
    points = (counted.filter((F.col("_days") >= min_days) & F.col("cum_share").isNotNull())
                     .groupBy(*keys, "hour").agg(round_half_up(F.avg("cum_share"), 6).alias("cum_share")))
    return _fill_hours(points, keys, "cum_share", until, monotone)


def with_segment(hourly: DataFrame, by: str = "weekend") -> DataFrame:
    """Weekday/weekend or weekday segment, to be used as one more profile key."""
    dow = F.weekday(DATE)
    value = F.when(dow >= 5, "weekend").otherwise("weekday") if by == "weekend" else dow.cast("string")
    return hourly.withColumn("segment", value)


def restore(daily: DataFrame, cum: Column | None = None, full_hour: int = FULL_DAY_HOUR,
            floor: float = CUM_FLOOR, cap: float = MAX_MULTIPLIER) -> DataFrame:
    """Demand of days that stopped early: sold / share reached, at most 5 x, at least sold."""
    cum = F.col("cum_at_stop") if cum is None else cum
    sold = F.col("sold")
    adjust = cum.isNotNull() & (F.col("last_hour") < full_hour) & (cum >= floor)
    estimate = F.greatest(sold, F.least(sold / F.nullif(cum, F.lit(0.0)), sold * cap))
    return daily.withColumns({
        "demand_estimated": round_half_up(F.when(adjust, estimate).otherwise(sold), 2),
        "lost_qty": round_half_up(F.when(adjust, estimate - sold).otherwise(0.0), 2),
        "is_censored": F.coalesce(adjust, F.lit(False)).cast("int"),
    })


def stop_days(hourly: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return hourly.groupBy(*keys, DATE).agg(F.sum("qty").alias("sold"), F.max("hour").alias("last_hour"))


def estimate_demand(hourly: DataFrame, profiles: DataFrame, keys: Sequence[str] = PAIR, **rule) -> DataFrame:
    """Join each pair-day to its profile at the stop hour and apply the rule.

    Hours before a profile's first hour have no match and are not censored."""
    at = profiles.select(*keys, F.col("hour").alias("last_hour"), F.col("cum_share").alias("cum_at_stop"))
    return restore(stop_days(hourly, keys).join(at, [*keys, "last_hour"], "left"), **rule)


def attach_demand(daily: DataFrame, estimates: DataFrame) -> DataFrame:
    """Demand columns on the daily table; rows without an estimate keep what was sold."""
    est = estimates.select(*PAIR, DATE, "demand_estimated", "lost_qty", "is_censored")
    out = daily.join(est, [*PAIR, DATE], "left")
    return out.withColumns({
        "demand": F.coalesce("demand_estimated", "sold"),
        "lost_qty": F.coalesce("lost_qty", F.lit(0.0)),
        "is_censored": F.coalesce("is_censored", F.lit(0)),
    }).drop("demand_estimated")


def uplift_report(df: DataFrame, group: str | None = None) -> DataFrame:
    sold, demand = F.avg("sold"), F.avg("demand")
    grouped = df.groupBy(group) if group else df.groupBy()
    return grouped.agg(
        F.count("*").alias("n_rows"), sold.alias("mean_sold"), demand.alias("mean_demand"),
        F.coalesce(ratio((demand - sold) * 100, sold), F.lit(0.0)).alias("uplift_pct"),
        F.avg("lost_qty").alias("mean_lost"), (F.avg("is_censored") * 100).alias("censored_pct"),
        F.count_if(F.col("demand") > F.col("sold")).alias("n_raised"))


def lost_revenue(estimates: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """Lost units and money of early-stop days per `product` or per stop hour.

    `prices` holds the mean line price per product."""
    early = estimates.filter(F.col("is_censored") == 1).join(prices, "product", "left")
    keys = ["product"] if by == "product" else ["last_hour"]
    money = F.col("lost_qty") * F.col("avg_price")
    return early.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("last_hour").alias("avg_stop_hour"),
        F.avg("sold").alias("avg_sold"), F.avg("demand_estimated").alias("avg_estimated"),
        F.avg("lost_qty").alias("avg_lost"), F.sum("lost_qty").alias("total_lost"),
        F.sum(money).alias("total_lost_revenue"), F.avg("cum_at_stop").alias("avg_cum_at_stop"),
    ).withColumn("avg_multiplier", F.col("avg_estimated") / F.col("avg_sold"))


FALLBACK_LEVELS = (("pair", ("store", "product")), ("product", ("product",)),
                   ("category", ("category",)), ("store", ("store",)), ("global", ()))


def hierarchical_profiles(hourly: DataFrame, min_days: int = MIN_FULL_DAYS) -> dict[str, DataFrame]:
    """Profiles at five levels from one pass over the hourly rows.

    Sums and counts per (pair, hour) are written once; each level adds up those small
    rows and never reads a store's or the chain's raw rows again.
    """
    shares = _full_day_shares(hourly, PAIR, FULL_DAY_HOUR)
    per = cut_lineage(shares.groupBy(*PAIR, "hour").agg(
        F.min("category").alias("category"), F.sum("cum_share").alias("_s"),
        F.count("cum_share").alias("_n"), F.sum("first_row").alias("_days")))
    out = {}
    for name, keys in FALLBACK_LEVELS:
        sums = per.groupBy(*keys, "hour").agg(*[F.sum(c).alias(c) for c in ("_s", "_n", "_days")])
        days = F.sum("_days").over(Window.partitionBy(*keys))  # at most 24 rows a key
        known = sums.withColumn("_d", days).filter((F.col("_d") >= min_days) & (F.col("_n") > 0))
        points = known.select(*keys, "hour", round_half_up(F.col("_s") / F.col("_n"), 6).alias("cum_share"))
        out[name] = _fill_hours(points, keys, "cum_share", 23, False)
    return out


def estimate_with_fallback(hourly: DataFrame, min_days: int = MIN_FULL_DAYS) -> DataFrame:
    """Demand from the most detailed level that knows the stop hour; `level` names it."""
    out = hourly.groupBy(*PAIR, DATE).agg(F.min("category").alias("category"), F.sum("qty").alias("sold"),
                                          F.max("hour").alias("last_hour"))
    levels = hierarchical_profiles(hourly, min_days)
    keys_of = dict(FALLBACK_LEVELS)
    for name, prof in levels.items():
        at = prof.select(*keys_of[name], F.col("hour").alias("last_hour"), F.col("cum_share").alias(f"_{name}"))
        out = out.join(at, [*keys_of[name], "last_hour"], "left")
    cols = [F.col(f"_{n}") for n in levels]
    level = F
    for n in levels:
        level = level.when(F.col(f"_{n}").isNotNull(), n)
    labelled = out.withColumns({"cum_at_stop": F.coalesce(*cols), "level": level.otherwise("none")})
    return restore(labelled.drop(*[f"_{n}" for n in levels]))


# ---- share of the store's sales -------------------------------------------------

def store_hours(hourly: DataFrame) -> DataFrame:
    """Store quantity per date and hour with something sold."""
    return hourly.groupBy("store", DATE, "hour").agg(F.sum("qty").alias("store_qty")).filter(F.col("store_qty") > 0)


def hour_share_profiles(hourly: DataFrame) -> DataFrame:
    """Mean share of a product in its store's hour.

    `avg_share` counts store hours without the product as 0: the shares are summed over
    the product's rows and divided by the store's number of such hours, so the zero rows
    are never built. `avg_share_sold` covers hours with a sale only; `avg_share_day` is
    the hours 7..20 raised to their median.
    """
    sh = store_hours(hourly)
    n = sh.groupBy("store", "hour").agg(F.count("*").alias("n_obs"))
    rows = hourly.join(sh, ["store", DATE, "hour"]).withColumn("share", F.col("qty") / F.col("store_qty"))
    per = rows.groupBy(*PAIR, "hour").agg(
        F.sum("share").alias("_s"), F.avg(F.when(F.col("qty") > 0, F.col("share"))).alias("_sold"))
    grid = hourly.select(*PAIR).distinct().join(n, "store")
    full = (grid.join(per, [*PAIR, "hour"], "left")
                .withColumns({"avg_share": F.coalesce("_s", F.lit(0.0)) / F.col("n_obs"),
                              "avg_share_sold": F.coalesce("_sold", F.lit(0.0))}))
    day = F.col("hour").between(7, 20)
    mid = F.percentile(F.when(day, F.col("avg_share")), 0.5).over(Window.partitionBy(*PAIR))
    return full.withColumn("avg_share_day", F.when(day, F.greatest(F.col("avg_share"), mid))).drop("_s", "_sold")


def share_expectations(hourly: DataFrame) -> DataFrame:
    """Actual and expected quantity of every pair on every day its store sold something.

    Store hours meet profiles on (store, hour), salted by date: the rows are the store's
    days x hours x products that the report is about.
    """
    prof = hour_share_profiles(hourly)
    sh = store_hours(hourly)
    actual = hourly.select(*PAIR, DATE, "hour", "qty")
    rows = salted_join(sh, prof, ["store", "hour"], [DATE], 8).join(actual, [*PAIR, DATE, "hour"], "left").fillna(0.0, subset=["qty"])
    expected = F.col("store_qty") * F.col("avg_share")
    return rows.groupBy(*PAIR, DATE).agg(
        F.sum("store_qty").alias("store_qty"), F.sum("qty").alias("actual"), F.sum(expected).alias("expected"),
        F.sum(F.abs(expected - F.col("qty"))).alias("abs_gap"),
        F.sum(F.col("store_qty") * F.col("avg_share_sold")).alias("expected_sold_hours"),
        F.coalesce(F.sum(F.col("store_qty") * F.col("avg_share_day")), F.lit(0.0)).alias("expected_day_hours"),
    ).withColumns({"gap": F.col("expected") - F.col("actual"),
                   "wmape": ratio(F.col("abs_gap"), F.col("actual"))})


def daily_share_variants(hourly: DataFrame, low_quantile: float = 0.2) -> DataFrame:
    """Expected quantity from the mean daily share, the weekday's mean share, and the mean
    over days above the pair's 20th-percentile share (null on the other days)."""
    per_pair = hourly.groupBy(*PAIR, DATE).agg(F.sum("qty").alias("actual"))
    per_store = hourly.groupBy("store", DATE).agg(F.sum("qty").alias("store_qty"))
    pairs = hourly.select(*PAIR).distinct()
    dense = (salted_join(per_store, pairs, ["store"], [DATE]).join(per_pair, [*PAIR, DATE], "left").fillna(0.0, subset=["actual"])
                      .withColumn("share", ratio(F.col("actual"), F.col("store_qty")))
                      .withColumn("_dow", F.weekday(DATE)))
    w, wd = Window.partitionBy(*PAIR), Window.partitionBy(*PAIR, "_dow")
    cut = dense.withColumns({
        "avg_share": F.avg("share").over(w), "weekday_share": F.avg("share").over(wd),
        "_cut": F.percentile("share", low_quantile).over(w)})
    high = F.col("share") > F.col("_cut")
    out = cut.withColumn("high_share", F.when(high, F.avg(F.when(high, F.col("share"))).over(w)))
    return out.withColumns({
        "expected_daily": F.col("store_qty") * F.col("avg_share"),
        "expected_weekday": F.col("store_qty") * F.col("weekday_share"),
        "expected_high": F.col("store_qty") * F.col("high_share"),
    }).drop("_dow", "_cut")


def share_matrix(hourly: DataFrame, group: Sequence[str] = ("store",)) -> DataFrame:
    """Product x hour matrix: the product's share of the group's quantity in each hour."""
    keys = list(group)
    per = hourly.groupBy(*keys, "product", "hour").agg(F.sum("qty").alias("qty"))
    total = per.groupBy(*keys, "hour").agg(F.sum("qty").alias("_t"))
    shares = per.join(total, [*keys, "hour"]).withColumn("share", ratio(F.col("qty"), F.col("_t")))
    wide = shares.groupBy(*keys, "product").pivot("hour", list(range(24))).agg(F.max("share"))
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in range(24)})


# ---- stock-out masks and censored rates -----------------------------------------

def pair_hour_grid(hourly: DataFrame) -> DataFrame:
    """Every pair-day with hours 0..23, its quantity and the store's traffic in that hour."""
    days = hourly.select(*PAIR, DATE).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    lines = "n_lines" if "n_lines" in hourly.columns else "qty"
    traffic = hourly.groupBy("store", DATE, "hour").agg(F.sum(lines).alias("traffic"))
    own = hourly.select(*PAIR, DATE, "hour", "qty")
    return (days.join(own, [*PAIR, DATE, "hour"], "left").join(traffic, ["store", DATE, "hour"], "left")
                .fillna(0.0, subset=["qty"]).fillna(0, subset=["traffic"]))


def _near(df: DataFrame) -> Column:
    w = Window.partitionBy(*PAIR, DATE).orderBy("hour").rowsBetween(-1, 1)
    return F.when(F.count("qty").over(w) == 3, F.sum("qty").over(w)).otherwise(0.0)


def stockout_mask(grid: DataFrame) -> DataFrame:
    """Hours without a sale although the store sold and the product sold next to it."""
    hit = (F.col("qty") == 0) & (F.col("traffic") > 0) & (F.col("near") > 0)
    return grid.withColumn("near", _near(grid)).withColumn("suspected", hit.cast("int"))


def advanced_stockout_mask(grid: DataFrame, threshold: float = 0.3, strict_max: float = 1.0) -> DataFrame:
    """Sales far below the hour's usual level while traffic was normal.

    The medians run over one pair's days in one hour."""
    hour = Window.partitionBy(*PAIR, "hour")
    usual = F.percentile(F.when(F.col("qty") > 0, F.col("qty")), 0.5).over(hour)
    traffic = F.percentile("traffic", 0.5).over(hour)
    base = grid.withColumns({"near": _near(grid), "usual_qty": usual, "usual_traffic": traffic})
    low = F.col("qty") < F.col("usual_qty") * threshold
    hit = low & (F.col("traffic") >= F.col("usual_traffic") * 0.5) & (F.col("near") > 0)
    return base.withColumn("suspected", F.coalesce(hit, F.lit(False)).cast("int")).withColumn(
        "strict", ((F.col("suspected") == 1) & (F.col("qty") <= strict_max)).cast("int"))


def censored_rates(masked: DataFrame, steps: int = 25) -> DataFrame:
    """Poisson rate per pair and hour where masked counts are only lower bounds (EM).

    Rows shrink to distinct (count, flag) with their multiplicity, at most one entry per
    day; the EM steps then run inside one expression, so no step adds a shuffle. Goods by weight keep
    their fractions; a censored fraction bounds the count by the next whole unit. `converged` is 1
    where one more step moves the rate by less than a thousandth.
    """
    cells = (masked.groupBy(*PAIR, "hour", F.col("qty").cast("double").alias("x"), F.col("strict").alias("c"))
                   .agg(F.count("*").alias("n")))
    per = cells.groupBy(*PAIR, "hour").agg(
        F.collect_list(F.struct("x", "c", "n")).alias("obs"), F.sum("n").alias("n_days"),
        F.sum(F.col("c") * F.col("n")).alias("n_censored"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("observed_rate"))

    def at_least(k: Column, rate: Column) -> Column:
        """P(X >= k): 1 minus the first k terms of the Poisson series."""
        def term(acc, j):
            p = F.when(j == 0, F.exp(-rate)).otherwise(acc["p"] * rate / j)
            return F.struct(p.alias("p"), (acc["s"] + p).alias("s"))
        zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("s"))
        js = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        return F.greatest(F.lit(1.0) - F.aggregate(js, zero, term)["s"], F.lit(1e-12))

    def expected(o, rate):
        k = F.ceil(o["x"]).cast("int")
        mean_above = rate * F.when(k > 0, at_least(k - 1, rate)).otherwise(1.0) / at_least(k, rate)
        return F.when(o["c"] == 1, F.greatest(mean_above, o["x"])).otherwise(o["x"])

    def step(rate, _):
        total = F.aggregate("obs", F.lit(0.0), lambda acc, o: acc + expected(o, rate) * o["n"])
        return total / F.col("n_days")

    start = F.greatest(F.col("observed_rate"), F.lit(1e-6))
    rate = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    moved = F.abs(step(F.col("rate"), None) - F.col("rate"))
    return per.withColumn("rate", rate).withColumn("converged", (moved <= 1e-3 * F.col("rate")).cast("int")).drop("obs")


def censored_rate_interval(masked: DataFrame, level: float = 0.9, steps: int = 50) -> DataFrame:
    """Likeliest Poisson rate per pair and hour with the interval its profile likelihood allows.

    Days that were not masked enter as their number and sum; masked ones say that the count was at least `qty`, and
    shrink to one entry per whole count. The rate is the root of the score, the limits are where twice the log
    likelihood has fallen by the chi-squared quantile of `level`; each is halved `steps` times from a
    bracket that is known to hold it, inside one expression. Without an unmasked day the likelihood
    has no maximum: rate and limits are null. Where nothing was sold or missed, rate and lower limit are 0.
    """
    drop = NormalDist().inv_cdf((1.0 + level) / 2.0) ** 2 / 2.0
    open_day = F.col("strict") == 0
    cells = masked.groupBy(*PAIR, "hour", F.when(~open_day, F.ceil(F.coalesce("qty", F.lit(0.0))).cast("int")).alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.col("qty").cast("double")).alias("x"))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(0.0), lambda acc, j: acc + F.log(j))
    bound = F.when(F.col("k") > 0, F.struct("k", "n", log_factorial.alias("lf")))
    is_open = F.col("k").isNull()
    per = cells.groupBy(*PAIR, "hour").agg(
        F.sum("n").alias("n_days"), F.coalesce(F.sum(F.when(~is_open, F.col("n"))), F.lit(0)).alias("n_censored"),
        F.coalesce(F.sum(F.when(is_open, F.col("n"))), F.lit(0)).alias("n0"),
        F.coalesce(F.sum(F.when(is_open, F.col("x"))), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.when(F.col("k") > 0, F.col("k") * F.col("n"))), F.lit(0)).alias("ks"),
        F.collect_list(bound).alias("obs"))

    def log_pmf(o: Column, rate: Column) -> Column:
        return o["k"] * F.log(rate) - rate - o["lf"]

    def log_tail(o: Column, rate: Column) -> Column:
        """log P(X >= k): the terms from k on where the rate is small, 1 minus those before k otherwise."""
        def grow(acc, j):
            t = acc["t"] * rate / (o["k"] + j)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        def fall(acc, j):
            t = F.when(j == 0, F.exp(-rate)).otherwise(acc["t"] * rate / j)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
        start = [F.struct(F.lit(v).alias("t"), F.lit(v).alias("s")) for v in (1.0, 0.0)]
        above = F.aggregate(F.sequence(F.lit(1), o["k"] + 60), start[0], grow)["s"]
        below = F.aggregate(F.sequence(F.lit(0), o["k"] - 1), start[1], fall)["s"]
        return (F.when(o["k"] == 1, F.log(-F.expm1(-rate)))
                 .when(rate > o["k"], F.log(F.lit(1.0) - below)).otherwise(log_pmf(o, rate) + F.log(above)))

    def score(rate: Column) -> Column:
        missed = F.aggregate("obs", F.lit(0.0), lambda acc, o: acc + o["n"] * o["k"] * F.exp(log_pmf(o, rate) - log_tail(o, rate)))
        return (F.col("s") + missed) / rate - F.col("n0")

    def likelihood(rate: Column) -> Column:
        sold = F.when(F.col("s") > 0, F.col("s") * F.log(rate)).otherwise(0.0) - F.col("n0") * rate
        return F.aggregate("obs", sold, lambda acc, o: acc + o["n"] * log_tail(o, rate))

    def halve(low: Column, width: Column, go_up) -> Column:
        def step(at, i):
            middle = at + width * F.pow(F.lit(0.5), i)
            return F.when(go_up(middle), middle).otherwise(at)
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), low, step)

    some = F.col("s") + F.col("ks") > 0
    solved = (per.withColumn("n0", F.when(F.col("n0") > 0, F.col("n0").cast("double")))
                 .withColumn("rate", F.when(some, halve(F.col("s") / F.col("n0"), F.col("ks") / F.col("n0"), lambda m: score(m) > 0))
                                      .when(F.col("n0").isNotNull(), 0.0))
                 .withColumn("_floor", F.when(some, likelihood(F.col("rate"))).otherwise(0.0) - drop))
    # sold * log(rate) lies below its tangent at 2 * s / n0, so the likelihood is under the floor beyond this rate
    tangent = F.when(F.col("s") > 0, F.col("s") * F.log(2.0 * F.col("s") / F.col("n0")) - F.col("s")).otherwise(0.0)
    far = F.greatest(F.col("rate"), (tangent - F.col("_floor")) * 2.0 / F.col("n0"))
    return (solved.withColumn("rate_low", F.when(some, halve(F.lit(0.0), F.col("rate"), lambda m: likelihood(m) < F.col("_floor")))
                                           .when(F.col("n0").isNotNull(), 0.0))
                  .withColumn("rate_high", halve(F.col("rate"), far - F.col("rate"), lambda m: likelihood(m) > F.col("_floor")))
                  .select(*PAIR, "hour", "n_days", "n_censored", *[F.when(F.col("n0").isNotNull(), F.col(c)).alias(c) for c in ("rate", "rate_low", "rate_high")]))


# ---- plans, baskets, timing ------------------------------------------------------

def recent_hour_profile(hourly: DataFrame, n_days: int = 30, min_days: int = 7) -> DataFrame:
    """Share of an average day by hour 6..22 from the pair's last sale days."""
    w = Window.partitionBy(*PAIR)
    ranked = hourly.withColumn("_day", F.dense_rank().over(w.orderBy(F.col(DATE).desc())))
    recent = ranked.filter(F.col("_day") <= n_days).withColumn("_days", F.max("_day").over(w))
    means = (recent.filter(F.col("_days") >= min_days).groupBy(*PAIR, "hour").agg(F.avg("qty").alias("_m"))
                   .withColumn("_t", F.sum("_m").over(w)))
    return (means.filter((F.col("_t") > 0) & F.col("hour").between(6, 22))
                 .select(*PAIR, "hour", round_half_up(F.col("_m") / F.col("_t"), 4).alias("share")))


def stored_increments(profiles: DataFrame) -> DataFrame:
    """Hourly shares 6..22 as differences of a stored cumulative profile.

    The first hour takes all that came before it; absent hours add nothing."""
    w = Window.partitionBy(*PAIR).orderBy("hour")
    day = profiles.filter(F.col("hour").between(6, 22))
    return day.select(*PAIR, "hour", round_half_up(
        F.col("cum_share") - F.coalesce(F.lag("cum_share").over(w), F.lit(0.0)), 4).alias("share"))


def hour_plan_shares(hourly: DataFrame, profiles: DataFrame) -> DataFrame:
    """Hour shares of all pairs: recent profile, else the stored one, else even 7..21.

    A pair takes all its hours from one source."""
    pairs = hourly.select(*PAIR).distinct()
    recent = recent_hour_profile(hourly)
    stored = stored_increments(profiles)
    sources = (pairs.join(recent.select(*PAIR).distinct().withColumn("_r", F.lit(1)), list(PAIR), "left")
                    .join(stored.select(*PAIR).distinct().withColumn("_s", F.lit(1)), list(PAIR), "left"))
    source = F.when(F.col("_r") == 1, "recent").when(F.col("_s") == 1, "stored").otherwise("even")
    grid = (sources.select(*PAIR, source.alias("source"))
                   .withColumn("hour", F.explode(F.sequence(F.lit(6), F.lit(22)))))
    both = (grid.join(recent.withColumnRenamed("share", "_rs"), [*PAIR, "hour"], "left")
                .join(stored.withColumnRenamed("share", "_ss"), [*PAIR, "hour"], "left"))
    even = F.when(F.col("hour").between(7, 21), F.lit(round(1 / 15, 4))).otherwise(0.0)
    share = F.when(F.col("source") == "recent", F.col("_rs")).when(F.col("source") == "stored", F.col("_ss"))
    return both.select(*PAIR, "hour", "source", F.coalesce(
        F.when(F.col("source") == "even", even).otherwise(share), F.lit(0.0)).alias("share"))


def hourly_plan(forecast: DataFrame, shares: DataFrame, hourly: DataFrame) -> DataFrame:
    """Forecast of the day spread over hours 6..22 next to what was sold."""
    actual = hourly.select(*PAIR, DATE, "hour", F.col("qty").alias("actual"))
    plan = forecast.select(*PAIR, DATE, "forecast").join(shares, list(PAIR))
    return (plan.withColumn("planned", F.col("forecast") * F.col("share"))
                .join(actual, [*PAIR, DATE, "hour"], "left").fillna(0.0, subset=["actual"]))


MASK_BITS = 60


def basket_affinity(lines: DataFrame, n_items: int = 20, check: str = "check_id") -> DataFrame:
    """Pair counts, support and lift among the n best-selling products, for any n.

    A check becomes a few bit masks of 60 products each (`bit_or` keeps 8 bytes per mask and check,
    whatever its size), equal masks are counted, and only distinct ones are unfolded into
    pairs. No check is collected and no join pairs its lines.
    """
    names = [f"_mask{w}" for w in range((n_items + MASK_BITS - 1) // MASK_BITS)]
    top = (lines.groupBy("product").agg(F.sum("qty").alias("_q")).orderBy(F.desc("_q"), "product").limit(n_items))
    order = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_q")).alias("q"), "product"))),
                                lambda s: s["product"])).scalar()  # n names
    pos = F.array_position(order, F.col("product"))
    bits = [F.when(F.expr(f"pos > {w * MASK_BITS} and pos <= {(w + 1) * MASK_BITS}"),
                   F.expr(f"shiftleft(1L, cast(pos - {w * MASK_BITS + 1} as int))")).otherwise(F.lit(0).cast("bigint")) for w in range(len(names))]
    masks = (lines.withColumn("pos", pos).groupBy(check).agg(*[F.bit_or(b).alias(m) for b, m in zip(bits, names)])
                  .groupBy(*names).agg(F.count("*").alias("n")))
    def members(word: int) -> Column:
        ids = F.sequence(F.lit(0), F.lit(min(MASK_BITS, n_items - word * MASK_BITS) - 1))
        set_bits = F.filter(ids, lambda i: F.call_function("getbit", F.col(names[word]), i) == 1)
        return F.transform(set_bits, lambda i: i + word * MASK_BITS)
    held = F.concat(*[members(word) for word in range(len(names))])
    sets = masks.withColumn("items", held)
    singles = (sets.withColumn("i", F.explode("items")).groupBy("i").agg(F.sum("n").alias("n")))
    counts = singles.agg(F.map_from_entries(F.collect_list(F.struct("i", "n")))).scalar()
    total = masks.agg(F.sum("n")).scalar()
    pairs = (sets.filter(F.size("items") >= 2).withColumn("a", F.explode("items"))
                 .withColumn("b", F.explode(F.filter("items", lambda i: i > F.col("a"))))
                 .groupBy("a", "b").agg(F.sum("n").alias("pair_count")))
    named = pairs.withColumns({"_names": order, "_c": counts, "n_checks": total})
    out = named.select(
        F.element_at("_names", F.col("a") + 1).alias("_x"), F.element_at("_names", F.col("b") + 1).alias("_y"),
        "pair_count", "n_checks", F.try_element_at("_c", F.col("a")).alias("_na"),
        F.try_element_at("_c", F.col("b")).alias("_nb"))
    return out.select(
        F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"), "pair_count",
        (F.col("pair_count") / F.col("n_checks")).alias("support"),
        (F.col("pair_count") / F.col("n_checks") /
         ((F.col("_na") / F.col("n_checks")) * (F.col("_nb") / F.col("n_checks")))).alias("lift"))


def affinity_matrix(affinity: DataFrame) -> DataFrame:
    """Both directions of every counted pair, in long form."""
    swap = affinity.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "pair_count")
    return affinity.select("item_a", "item_b", "pair_count").unionByName(swap)


def purchase_time_groups(lines: DataFrame, morning: int = 10, lunch: int = 13) -> DataFrame:
    per = lines.groupBy("product").agg(F.avg("hour").alias("avg_hour"), F.count("*").alias("n_lines"))
    group = F.when(F.col("avg_hour") <= morning, "morning").when(F.col("avg_hour") <= lunch, "lunch")
    return per.withColumn("time_group", group.otherwise("afternoon"))


def milestone_hours(hourly: DataFrame, keys: Sequence[str] = ("product",),
                    hours: Sequence[int] = (8, 10, 12, 14, 16, 18)) -> DataFrame:
    """First hour by which 50 % / 80 % of a mean day is sold, a time type, and the share
    reached by fixed hours."""
    per_day = hourly.groupBy(*keys, DATE, "hour").agg(F.sum("qty").alias("qty"))
    day = Window.partitionBy(*keys, DATE)
    share = per_day.withColumn("share", ratio(F.col("qty"), F.sum("qty").over(day)))
    mean = share.groupBy(*keys, "hour").agg(F.avg("share").alias("share"))
    w = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    cum = mean.withColumn("cum", F.sum("share").over(w))

    def first_hour(p):  # a share is reached up to rounding of the sum
        return F.min(F.when(F.col("cum") >= p - 1e-9, F.col("hour")))

    out = cum.groupBy(*keys).agg(
        first_hour(0.5).alias("h50"), first_hour(0.8).alias("h80"),
        *[F.coalesce(F.max_by("cum", F.when(F.col("hour") <= h, F.col("hour"))), F.lit(0.0)).alias(f"by_{h}")
          for h in hours])
    kind = F.when(F.col("h50") <= 10, "morning").when(F.col("h50") <= 12, "lunch").otherwise("even")
    return out.withColumn("time_type", kind)


def substitution_effect(df: DataFrame) -> DataFrame:
    """Rows in stock with their norm and the number of other products sold out around them."""
    out_flag = (F.col("stock") == 0).cast("int")
    norm = df.groupBy(*PAIR).agg(F.avg("sold").alias("avg_sold"))
    store = df.groupBy("store", DATE).agg(F.sum(out_flag).alias("_so"))
    cat = df.groupBy("store", DATE, "category").agg(F.sum(out_flag).alias("_sc"))
    joined = df.join(norm, list(PAIR)).join(store, ["store", DATE]).join(cat, ["store", DATE, "category"])
    return joined.withColumns({
        "others_out": F.col("_so") - out_flag, "others_out_category": F.col("_sc") - out_flag,
        "delta": F.col("sold") - F.col("avg_sold"), "ratio": F.col("sold") / (F.col("avg_sold") + 0.1),
    }).filter(F.col("stock") > 0).drop("_so", "_sc")


def substitution_buckets(effect: DataFrame, col: str, bounds: Sequence[tuple[float, str]], last: str) -> DataFrame:
    label = F
    for upper, name in bounds:
        label = label.when(F.col(col) <= upper, name)
    return effect.groupBy(label.otherwise(last).alias("bucket")).agg(
        F.count("*").alias("n_rows"), F.avg("sold").alias("avg_sold"), F.avg("avg_sold").alias("avg_norm"),
        F.avg("delta").alias("avg_delta"), F.avg("ratio").alias("avg_ratio"))


def substitution_by_category(effect: DataFrame, high: int = 5) -> DataFrame:
    few, many = F.col("others_out") <= 0, F.col("others_out") >= high
    return effect.groupBy("category").agg(
        F.avg(F.when(few, F.col("delta"))).alias("delta_none"), F.count_if(few).alias("n_none"),
        F.avg(F.when(many, F.col("delta"))).alias("delta_many"), F.count_if(many).alias("n_many"),
    ).withColumn("difference", F.coalesce(F.col("delta_many") - F.col("delta_none"), F.lit(0.0)))


def two_stage_restoration(df: DataFrame, segment: Sequence[str]) -> DataFrame:
    """Demand = sold + P(censored) x mean loss given censored, both learnt per segment."""
    per = df.groupBy(*segment).agg(
        F.avg("is_censored").alias("p_censored"),
        F.coalesce(F.avg(F.when(F.col("is_censored") == 1, F.col("lost_qty"))), F.lit(0.0)).alias("loss_if_censored"))
    return (df.join(per, list(segment))
              .withColumn("expected_lost", F.col("p_censored") * F.col("loss_if_censored"))
              .withColumn("demand_two_stage", F.col("sold") + F.col("expected_lost")))
