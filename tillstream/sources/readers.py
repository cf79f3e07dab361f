"""Scans and the shaping that happens right after them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillstream import schemas
from tillstream.functions.text import parse_number


def canonicalise_columns(df: DataFrame, aliases: dict[str, str] | None = None,
                         required: Sequence[str] = ()) -> DataFrame:
    """Rename known headers; a missing required column is an error."""
    aliases = schemas.HEADER_ALIASES if aliases is None else aliases
    renames = {c: aliases[c] for c in df.columns if c in aliases}
    if aliases and not renames and not set(aliases.values()) & set(df.columns):
        raise ValueError(f"none of the known headers is present in {df.columns}")
    out = df.withColumnsRenamed(renames)
    doubled = sorted({c for c in out.columns if out.columns.count(c) > 1})
    if doubled:
        raise ValueError(f"several headers map to {doubled}")
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    return out


def _decode(col: str, codes: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(col)), F.col(col))


def type_check_lines(raw: DataFrame) -> DataFrame:
    """Text check lines -> typed check lines; unreadable cells become null."""
    return raw.select(
        F.to_date(F.try_to_timestamp("sale_date", F.lit("dd.MM.yyyy"))).alias("date"),
        F.try_to_timestamp("check_ts", F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz").alias("check_ts"),
        _decode("event_type", schemas.EVENT_CODES).alias("event_type"),
        "store", "category", "product",
        _decode("freshness", schemas.FRESHNESS_CODES).alias("freshness"),
        parse_number(F.col("price")).alias("price"),
        parse_number(F.col("qty")).alias("qty"),
        parse_number(F.col("amount")).alias("amount"),
        "seller",
    )


OPTIONAL = ("seller",)  # null where a file does not have it; any other absent header is an error


def read_check_lines(spark: SparkSession, path: str | list[str], fmt: str = "csv",
                     header: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Typed check lines from CSV (text cells, source headers) or Parquet/ORC.

    `header` lists the file's own column names in order. Without it the names are
    taken from the first line only; no data row is read to infer types. The CSV
    reader skips a byte-order mark by itself.
    """
    if fmt != "csv":
        return canonicalise_columns(spark.read.format(fmt).options(**options).load(path))
    reader = spark.read.option("header", True).option("multiLine", False).options(**options)
    if header:
        reader = reader.schema(T.StructType([T.StructField(h, T.StringType()) for h in header]))
    raw = canonicalise_columns(reader.csv(path))
    absent = [f.name for f in schemas.CHECK_LINES_RAW if f.name not in raw.columns]
    if set(absent) - set(OPTIONAL):
        raise ValueError(f"the file lacks the columns {absent}")
    return type_check_lines(raw.withColumns({c: F.lit(None).cast("string") for c in absent}))


def read_drops(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.csv") -> DataFrame:
    """Many small drops below `path`; malformed lines land in `_bad_line`."""
    with_bad = T.StructType(schema.fields + [T.StructField("_bad_line", T.StringType())])
    return (spark.read.option("header", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad_line").schema(with_bad).csv(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def union_drops(drops: Sequence[DataFrame]) -> DataFrame:
    """Stack drops by column name and keep one copy of identical rows."""
    out = drops[0]
    for d in drops[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.dropDuplicates()


def split_drops(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct good rows, malformed lines with their file)."""
    good = df.filter(F.col("_bad_line").isNull()).drop("_bad_line", "source_file").dropDuplicates()
    bad = df.filter(F.col("_bad_line").isNotNull()).select("source_file", "_bad_line")
    return good, bad


def merge_at_cutoff(old: DataFrame, new: DataFrame, cutoff: Column | str, date: str = "date") -> DataFrame:
    """Old rows before the cutoff and new rows from it on, over their common columns."""
    cutoff = F.to_date(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    common = [c for c in old.columns if c in new.columns]
    return (old.filter(F.col(date) < cutoff).select(common)
               .unionByName(new.filter(F.col(date) >= cutoff).select(common)))


def star_extract(fact: DataFrame, stores: DataFrame, products: DataFrame,
                 store_key: str = "store_id", product_key: str = "product_id",
                 where: Column | None = None) -> DataFrame:
    """Distinct fact rows with store and product attributes.

    Catalyst broadcasts a dimension below the broadcast threshold and otherwise
    sort-merges with AQE splitting hot partitions, so no hint is given here.
    """
    joined = fact.join(stores, store_key).join(products, product_key)
    return (joined if where is None else joined.filter(where)).distinct()


def read_star(spark: SparkSession, options: dict[str, str], fact: str, stores: str, products: str,
              fact_options: dict[str, str] | None = None, **kwargs) -> DataFrame:
    """`star_extract` over three JDBC tables; the filter is pushed to the database.

    `fact_options` are the fact table's own: `partitionColumn`, `lowerBound`, `upperBound` and
    `numPartitions` read it in parallel. Without them one task reads the whole table.
    """
    def load(table: str, **own: str) -> DataFrame:
        return spark.read.format("jdbc").options(**{**options, **own, "dbtable": table}).load()
    return star_extract(load(fact, **(fact_options or {})), load(stores), load(products), **kwargs)


def full_months(df: DataFrame, date: str = "date") -> DataFrame:
    """Months in which every calendar day occurs."""
    month = F.trunc(F.col(date), "MM")
    return (df.filter(F.col(date).isNotNull())
              .groupBy(month.alias("month")).agg(F.countDistinct(date).alias("n_days"))
              .filter(F.col("n_days") == F.dayofmonth(F.last_day("month"))))


def last_full_month(df: DataFrame, date: str = "date") -> DataFrame:
    """One row: the latest full month."""
    return full_months(df, date).agg(F.max("month").alias("month"))


def month_slice(lines: DataFrame, month: Column, date: str = "date", event: str = "event_type") -> DataFrame:
    """Sale rows of one month. A literal month prunes monthly partitions; a scalar
    subquery (`last_full_month(df).scalar()`) reaches the scan as a runtime filter."""
    return lines.filter((F.col(event) == "sale") & (F.col(date) >= month)
                        & (F.col(date) < F.add_months(month, 1)))
