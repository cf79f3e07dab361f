"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's key is -ln(u) / w: u is a hash of its id in (0, 1), w its quality weight. Ascending keys
order a source as a weighted sample without replacement. A target takes complete epochs of its source
first; the rest goes to the documents of the smallest keys, whose sizes are prefix-summed up to the
budget. The document at which the budget ends gives its first words only.

A source may hold a third of all rows, so no window runs over a whole source. Keys fall into
`BUCKETS` equal shares of their range; sizes are summed per bucket before anything is shuffled, and
only the documents of the one bucket in which a budget ends are ordered. The sources themselves (one
row each, after summing) are ordered in one window.

Defined results: null text has size 0; null source is a source, the last; a row of size 0 takes
nothing; rows equal in key and id are interchangeable; empty input gives no rows. A target is at most
`CAP` times the source, so no document exceeds `CAP` times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.llm.common import WHITE, WORD, cut_lineage, text_or_empty

CYCLE = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BUCKETS = 16384
SEED = "mix"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def quality_weight(column: str = "text") -> Column:
    """Share of letters among the characters, at least 0.05."""
    letters = F.length(F.regexp_replace(text_or_empty(column), "[^\\p{L}]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.length(text_or_empty(column)), F.lit(1)))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """Hash of the id, strictly between 0 and 1 (52 bits)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources share `share` times all sizes by weight; a target stops at `cap` times its source and the
    excess goes to the others by weight until none is above. That is one level per weight: sources in
    order of cap / weight are full up to the first whose fair share fits.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_code) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank + 1).cast("int"))
    full = F.col("source_size") * F.lit(cap)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = ((F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    fits = F.col("level") <= F.col("full") / F.col("weight")
    return (sizes.withColumn("weight", weight).withColumn("full", full).withColumn("level", level)
            .withColumn("at", F.min(F.when(fits, F.struct(F.col("full") / F.col("weight"), F.col("level").alias("level")))).over(whole))
            .select("source", "source_size",
                    F.least(F.col("full"), F.coalesce(F.col("at.level") * F.col("weight"), F.col("full"))).alias("target")))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, cycle=CYCLE,
        share: float = SHARE, cap: float = CAP, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per row of `docs` (doc_id, source, text): doc_id, source, digest, size, source_size, target, taken."""
    size = word_count() if size is None else size
    weight = quality_weight() if weight is None else weight
    key = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)) / weight
    rows = cut_lineage(docs.select(
        "doc_id", "source", F.xxhash64(text_or_empty()).alias("digest"), size.alias("size"), key.alias("key"))
        .withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets)).cast("int")))
    per_bucket = cut_lineage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn(
        "budget", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = per_bucket.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    ends = (running.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
            .filter(F.col("before") < F.col("budget")).groupBy(F.col("p.source").alias("source"))
            .agg(F.max(F.struct("bucket", "before")).alias("last")))
    plan = cut_lineage(plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select(
        F.col("p.source").alias("_source"), "source_size", "target", "epochs", "budget",
        F.coalesce(F.col("last.bucket"), F.lit(-1)).alias("edge"), F.coalesce(F.col("last.before"), F.lit(0)).alias("before")))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    inner = placed.filter(F.col("bucket") != F.col("edge")).withColumn(
        "part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    by_key = (Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "digest")
              .rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(by_key), F.lit(0))
    edge = placed.filter(F.col("bucket") == F.col("edge")).withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return inner.unionByName(edge).select(
        "doc_id", "source", "digest", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def first_words(text: Column, count: Column) -> Column:
    """The first `count` words with the white space between them."""
    parts = F.split(F.ltrim(text, F.lit(WHITE)), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    return F.rtrim(F.array_join(F.slice(parts, 1, count), ""), F.lit(WHITE))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix takes them: a row per epoch, the document at a budget's end cut, others gone.

    Rows equal in id, source and text share evenly what the mix takes of them.
    """
    digest, words, size, epoch, ident, origin, other = (f"_{c}_{len(docs.columns)}" for c in (
        "digest", "words", "size", "epoch", "id", "source", "other"))
    chosen = mix(docs, **options).groupBy(
        F.col("doc_id").alias(ident), F.col("source").alias(origin), F.col("digest").alias(other)).agg(
        F.floor(F.sum("taken") / F.count("*")).cast("int").alias(words), F.max("size").cast("int").alias(size)).filter(F.col(words) > 0)
    wide = docs.withColumn(digest, F.xxhash64(text_or_empty()))
    on = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(origin)) & (F.col(digest) == F.col(other))
    left = F.col(words) - F.col(epoch) * F.col(size)
    rows = wide.join(chosen, on).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.ceil(F.col(words) / F.col(size)).cast("int") - 1)))
    cut = F.when(left < F.col(size), first_words(F.col("text"), left)).otherwise(F.col("text"))
    return rows.withColumn("text", cut).select(*[F.col(f"`{c}`") for c in docs.columns])
