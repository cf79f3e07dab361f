"""Exact dedup by deterministic block naming.

A text, without its white space, is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted and numbered; then neighbouring names are paired, distinct pairs sorted and numbered, and so on
until a document has one name. Two documents have the same (level, name) exactly when their
normalised texts are equal: names come from comparing contents, and a join key that two different
blocks share is found and replaced, so no hash decides.

The text is shuffled once: a block travels to its names as a 128-bit key, under which the smallest and
the largest block are kept. Where they differ the key stood for two blocks, and the level starts
again with another seed. Names come back to documents over these short keys, and a block that a third
of all documents share is a skewed join side with one row on the other, which Spark splits.

Defined results: null text counts as empty; all empty texts are one group; null ids sort last among
equal rows; a repeated row is a document of its own, and just one row of a group stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.llm.common import WHITE, cut_lineage, keep_rows, text_or_empty

BLOCK_BYTES = 4096
PAD = -1


def normalised(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), WHITE, "")


def _blocks(content: Column, size: int) -> Column:
    """The fixed-size blocks of a binary column; an empty text is one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.substring(content, i * F.lit(size) + F.lit(1), F.lit(size)))


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("k1"),
                    F.xxhash64(F.lit(seed + 1), F.lit("second"), block).alias("k2"))


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Sort each partition and number its rows; numbers are unique over all partitions."""
    return df.sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key=_key, seeds: int = 8) -> DataFrame:
    """One row per row of `docs`: rid, doc_id, n_points, text_sha256, level, name."""
    content = docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("n_points"),
                          normalised().cast("binary").alias("content"))
    for seed in range(0, 100 * seeds, 100):
        rows = cut_lineage(content.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "n_points",
            F.sha2("content", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("content"), block_bytes), lambda b: key(b, seed)).alias("keys")))
        blocks = content.select(F.explode(_blocks(F.col("content"), block_bytes)).alias("block"))
        keyed = blocks.select(key(F.col("block"), seed).alias("k"), "block")
        smallest = keyed.groupBy("k").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        names = cut_lineage(_numbered(smallest, ["low"], "name").select(
            F.col("k.k1"), F.col("k.k2"), "name", (F.col("low") != F.col("high")).alias("clash")))
        if names.filter("clash").isEmpty():
            break
    else:
        raise RuntimeError("every seed gave one key to different blocks")

    places = rows.select("rid", F.posexplode("keys").alias("idx", "k")).select("rid", "idx", "k.k1", "k.k2")
    named = places.join(names.drop("clash"), ["k1", "k2"]).select("rid", "idx", "name")
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    last = rows.filter(F.size("keys") == 1).select("rid")
    done = named.join(last, "rid", "left_semi").select("rid", F.lit(0).alias("level"), "name") if most > 1 else \
        named.select("rid", F.lit(0).alias("level"), "name")
    level = 0
    if most > 1:
        named = named.join(last, "rid", "left_anti")
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = F.floor(F.col("idx") / 2).cast("int")
        pairs = cut_lineage(named.groupBy("rid", half.alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(PAD)).alias("b")))
        labels = cut_lineage(_numbered(pairs.select("a", "b").distinct(), ["a", "b"], "name"))
        named = pairs.join(labels, ["a", "b"]).select("rid", "idx", "name")
        if most > 1:
            longer = pairs.filter(F.col("idx") > 0).select("rid").distinct()
            done = done.unionByName(named.join(longer, "rid", "left_anti").select("rid", F.lit(level).alias("level"), "name"))
            named = named.join(longer, "rid", "left_semi")
        else:
            done = done.unionByName(named.select("rid", F.lit(level).alias("level"), "name"))
    return rows.drop("keys").join(done, "rid")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of `docs`: rid, doc_id, n_points, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points in the original stays, then the smallest id.
    """
    named = cut_lineage(name_documents(docs, block_bytes))
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                     F.col("doc_id"), F.col("rid"))
    groups = named.groupBy("level", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "rid", "doc_id", "n_points", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("best.rid") == F.col("rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they are."""
    sha, points, copies = (f"{c}_{len(docs.columns)}" for c in ("_sha", "_points", "_copies"))
    keys = exact_groups(docs, block_bytes).groupBy("doc_id", F.col("text_sha256").alias(sha), F.col("n_points").alias(points)).agg(
        F.count("*").alias(copies), F.max("kept").alias("kept")).filter("kept")
    wide = docs.withColumns({sha: F.sha2(normalised().cast("binary"), 256),
                             points: F.length(text_or_empty()).cast("long")})
    return keep_rows(wide, keys, ["doc_id", sha, points], copies).drop(sha, points)
