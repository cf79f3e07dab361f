"""Marts, profile store, run log and prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillstream import schemas


def write_mart(df: DataFrame, path: str, date: str = "date") -> None:
    """Monthly partitions; only the months present in `df` are replaced.

    The rebalance hint lets AQE size the files: small months share a task and a large or
    hot month is split over many.
    """
    (df.withColumn("month", F.date_format(date, "yyyy-MM"))
       .hint("rebalance", "month")
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("month").parquet(path))


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "modificationTime", "length"))


def write_mart_if_changed(df: DataFrame, path: str, input_path: str, state_path: str,
                          date: str = "date") -> bool:
    """Write the mart unless path, time and size of every input file are as last time.

    Only file attributes are read: the content column is pruned from the scan.
    """
    spark = df.sparkSession
    now = _versions(spark, input_path)
    try:
        before = spark.read.parquet(state_path)
    except Exception as error:  # first run: there is no state yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = None
    if before is not None:
        changed = now.exceptAll(before).union(before.exceptAll(now))
        if changed.isEmpty():
            return False
    write_mart(df, path, date)
    now.write.mode("overwrite").parquet(state_path)
    return True


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Long profile rows: (store, product, hour, cum_share)."""
    profiles.select(*schemas.PROFILE.fieldNames()).write.mode("overwrite").parquet(path)


def nested_profiles(profiles: DataFrame) -> DataFrame:
    """One JSON object per pair, hour -> cumulative share; at most 24 entries each."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("hour").cast("string").alias("key"),
                                                   F.col("cum_share").alias("value"))))
    return (profiles.groupBy("store", "product")
            .agg(F.to_json(F.map_from_entries(entries)).alias("profile")))


def unnest_profiles(nested: DataFrame) -> DataFrame:
    """Inverse of `nested_profiles`."""
    parsed = F.from_json("profile", "map<string,double>")
    return (nested.select("store", "product", F.explode(parsed).alias("hour", "cum_share"))
            .withColumn("hour", F.col("hour").cast("int")))


def write_run(metrics: DataFrame, predictions: DataFrame | None, root: str, run_id: str) -> None:
    """Append a run's metrics and predictions, keyed by run id.

    A repeated run id replaces its own partition, so a retry leaves no copies.
    """
    def put(df: DataFrame, name: str) -> None:
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}"))
    put(metrics, "metrics")
    if predictions is not None:
        put(predictions, "predictions")


def append_prediction_log(df: DataFrame, path: str) -> None:
    """Append served predictions, partitioned by the day they were served."""
    (df.select(*schemas.PREDICTION_LOG.fieldNames())
       .withColumn("served_on", F.to_date("timestamp"))
       .write.mode("append").partitionBy("served_on").parquet(path))
