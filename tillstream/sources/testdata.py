"""The driver's tables seen as till data (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillstream.functions.calendar import flag


class Tables:
    """Lazy table access: `Tables(spark, sf_dir)("lineitem")`; a footer is read once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]


def check_lines(t: Tables, sales_only: bool = False) -> DataFrame:
    """Check lines: store = supplier's nation, product = brand, category = part type.

    `sales_only` filters on the stored flag, which the Parquet scan can push down.
    """
    stores = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                  F.col("s_nationkey").alias("store"))
    cities = t("nation").select(F.col("n_nationkey").alias("store"), F.col("n_name").alias("city"))
    products = t("part").select(F.col("p_partkey").alias("l_partkey"),
                                F.col("p_brand").alias("product"), F.col("p_type").alias("category"))
    lines = t("lineitem")
    if sales_only:
        lines = lines.filter(F.col("l_returnflag") == "N")
    return (lines
            .join(products, "l_partkey").join(stores, "l_suppkey").join(cities, "store")
            .select(
                F.col("l_orderkey").alias("check_id"),
                F.to_date("l_shipdate").alias("date"),
                "store", "city", "product", "category",
                F.col("l_partkey").alias("part"),
                F.col("l_suppkey").alias("supplier"),
                F.col("l_quantity").alias("qty"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                F.col("l_extendedprice").alias("amount"),
                F.when(F.col("l_returnflag") == "N", "sale").when(F.col("l_returnflag") == "R", "return")
                 .otherwise("cancel").alias("event_type"),
                F.when(F.col("l_linestatus") == "O", "fresh").otherwise("yesterday").alias("freshness"),
            ))


def sales(t: Tables) -> DataFrame:
    return check_lines(t, sales_only=True)


def daily(t: Tables) -> DataFrame:
    """Dense daily series: product = part type, category = its first letter."""
    return (sales(t).groupBy("store", F.col("category").alias("product"), "city", "date")
            .agg(F.sum("qty").alias("sold"))
            .withColumn("category", F.substring("product", 1, 1)))


def daily_fine(t: Tables) -> DataFrame:
    """Daily rows at store x category x brand."""
    return sales(t).groupBy("date", "store", "category", "product").agg(F.sum("qty").alias("sold"))


def stock_daily(t: Tables) -> DataFrame:
    """Dense daily series with produced, stock, lost quantity and demand by fixed arithmetic."""
    doy = F.dayofyear("date")
    extra = (doy + F.col("store") * 7) % 11
    df = daily(t).withColumns({
        "produced": F.col("sold") + extra,
        "stock": F.greatest(extra - 3, F.lit(0)).cast("double"),
    })
    out = df.withColumns({
        "is_censored": flag(F.col("stock") == 0),
        "lost_qty": F.when(F.col("stock") == 0, (doy + F.col("store")) % 5).otherwise(0).cast("double"),
    })
    return out.withColumn("demand", F.col("sold") + F.col("lost_qty"))


def hourly(t: Tables) -> DataFrame:
    """Hourly series: store = user, product = event type, one unit per event.

    Null keys are dropped here, which also keeps every use of the mart the same subplan, so
    that Spark reuses its exchange.
    """
    keys = ["store", "product", "date", "hour"]
    known = F.col("user_id").isNotNull() & F.col("event_type").isNotNull() & F.hour("ts").isNotNull()
    rows = t("events").filter(known).select(F.col("user_id").alias("store"), F.col("event_type").alias("product"),
                              F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "value")
    return (rows.groupBy(*keys)
                .agg(F.count("*").cast("double").alias("qty"), F.sum("value").alias("amount")))


def daily_prices(t: Tables) -> DataFrame:
    """Average sale price weighted by quantity, at the dense grain."""
    return (sales(t).groupBy("store", F.col("category").alias("product"), "date")
            .agg((F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("avg_price")))


def weather(t: Tables) -> DataFrame:
    """City x date rows for the days on which that nation's customers ordered."""
    days = (t("orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("date"))
            .join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
            .select("n_nationkey", "date").distinct()
            .join(t("nation").select("n_nationkey", F.col("n_name").alias("city")), "n_nationkey"))
    doy, n = F.dayofyear("date"), F.col("n_nationkey")
    df = days.withColumns({
        "temp_mean": ((doy * 7 + n * 13) % 50 - 20).cast("double"),
        "rain": ((doy * 3 + n) % 8) * 0.5,
        "snowfall": ((doy + n * 3) % 5) * 0.25,
        "windspeed_max": ((doy * 11 + n) % 45).cast("double"),
        "weathercode": F.element_at(F.array(*[F.lit(float(c)) for c in (0, 2, 45, 61, 71, 80, 95)]),
                                    ((doy + n) % 7 + 1).cast("int")),
    })
    return df.select(
        "city", "date", (F.col("temp_mean") + doy % 7).alias("temp_max"),
        (F.col("temp_mean") - doy % 5).alias("temp_min"), "temp_mean",
        (F.col("rain") + F.col("snowfall")).alias("precipitation"),
        "rain", "snowfall", "windspeed_max", "weathercode")


def sale_events(t: Tables) -> DataFrame:
    """Events as till lines with a time of day; freshness comes from the JSON payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select(
        F.col("event_id").alias("check_id"), F.col("user_id").alias("store"),
        F.col("event_type").alias("product"), F.col("user_id").alias("seller"),
        F.col("ts").alias("check_ts"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour"),
        F.lit(1.0).alias("qty"), F.col("value").alias("amount"),
        F.when(k < 50, "fresh").otherwise("yesterday").alias("freshness"))
