"""Row filters, projections and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillstream.functions.maths import clip
from tillstream.functions.text import has_any_word, normalise_store, parse_flag
from tillstream.operators.common import DATE, PAIR, max_date


def keep_sales(df: DataFrame, event: str = "event_type") -> DataFrame:
    return df.filter(F.col(event) == "sale")


def clip_at_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative quantities become 0; apply after the full sum, never before it."""
    return df.withColumns({c: clip(F.col(c), 0.0) for c in cols})


def count_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c) < 0).alias(f"{c}_fixed") for c in cols])


def merge_store_copies(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Normalise store names and add up rows that fall together by it."""
    return (df.withColumn("store", normalise_store(F.col("store")))
              .groupBy("store", *keys).agg(F.sum(value).alias(value)))


def first_category(df: DataFrame) -> DataFrame:
    """product -> category it was first seen with (smallest name on that day)."""
    return (df.filter(F.col("category").isNotNull()).groupBy("product")
              .agg(F.min(F.struct(DATE, "category")).alias("_f"))
              .select("product", F.col("_f.category").alias("category")))


def attach_category(df: DataFrame, mapping: DataFrame, default: str = "other") -> DataFrame:
    plain = df.drop("category")
    return (plain.join(mapping, "product", "left")
                 .withColumn("category", F.coalesce("category", F.lit(default))))


def always_sold(df: DataFrame, min_share: float = 0.98) -> DataFrame:
    """Rows of products sold on at least `min_share` of all days."""
    days = df.agg(F.countDistinct(DATE)).scalar()
    regular = (df.groupBy("product").agg(F.countDistinct(DATE).alias("_d"))
                 .filter(F.col("_d") / days >= min_share))
    return df.join(regular, "product", "left_semi")


def exclude_words(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    return df.filter(~has_any_word(F.col(col), words))


def last_days(df: DataFrame, n: int, date: str = DATE) -> DataFrame:
    """The last n calendar days, the latest one included."""
    return df.filter(F.col(date) >= F.date_sub(max_date(df, date), n - 1))


def drop_warmup(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def label_split(df: DataFrame, test_days: int, date: str = DATE) -> DataFrame:
    """is_test = 1 for the last `test_days` calendar days, inclusive."""
    start = F.date_sub(max_date(df, date), test_days - 1)
    return df.withColumn("is_test", (F.col(date) >= start).cast("int"))


def train_test(df: DataFrame, test_days: int, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    start = F.date_sub(max_date(df, date), test_days - 1)
    return df.filter(F.col(date) < start), df.filter(F.col(date) >= start)


def drop_false_zeros(df: DataFrame) -> DataFrame:
    return df.filter(~((F.col("sold") == 0) & (F.col("produced") == 0)))


def long_series(df: DataFrame, min_rows: int, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rows of series with enough observations; counts are combined map-side."""
    keep = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    return df.join(keep, list(keys), "left_semi")


def usable_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: non-null rows and whether it varies (min < max), in one pass."""
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_values"),
                            F.coalesce(F.min(c) < F.max(c), F.lit(False)).cast("int").alias("usable"))
                   .alias(f"_{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def weak_skus(best: DataFrame, threshold: float, col: str = "best_r2") -> DataFrame:
    """Pairs whose score is a number below the threshold."""
    score = F.col(col).try_cast("double")
    return best.withColumn(col, score).filter(score.isNotNull() & (score < threshold))


def flag_weak(df: DataFrame, best: DataFrame, threshold: float, base_model: str) -> DataFrame:
    weak = best.select(*PAIR, "best_model", F.col("best_r2").try_cast("double").alias("best_r2"))
    out = df.join(weak, list(PAIR), "left")
    is_weak = F.coalesce(F.col("best_r2") < threshold, F.lit(False))
    return out.withColumns({
        "best_model": F.coalesce("best_model", F.lit("")),
        "is_weak_sku": is_weak.cast("int"),
        "is_base_weak": (is_weak & (F.col("best_model") == base_model)).cast("int"),
    })


def routable(df: DataFrame) -> DataFrame:
    """Rows with model metrics, not all missing, and a history that is not short."""
    has, gone, short = "has_model_metrics", "all_model_metrics_missing", "is_short_history"
    typed = df.withColumns({c: parse_flag(F.col(c)) for c in (has, gone, short) if c in df.columns})
    for c, want in ((has, True), (gone, False), (short, False)):
        if c in df.columns:
            typed = typed.filter(F.col(c) == want)
    return typed


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def literal_grid(col: str, values: Sequence) -> Column:
    """Column that yields one row per listed value when selected."""
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(col)
