"""Connected components of an edge list, by contracting each node into its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.llm.common import cut_lineage

HASH = 16


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): nodes have one root exactly when edges connect them.

    Names (strings) are compared by their hashes: in that random order each round leaves a fraction of the
    nodes, also on long paths. Smallest neighbours are pre-aggregated, so a hub costs one row per task;
    joins have unique nodes on one side, so that skewed ones can be split.
    """
    def shuffled(name: str) -> Column:
        return F.concat(F.lpad(F.hex(F.xxhash64(name)), HASH, "0"), F.col(name)).alias(name)
    edges = cut_lineage(edges.filter("a <> b").select(shuffled("a"), shuffled("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                           .select("node", F.least("node", "low").alias("root")))
        steps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")) for c in ("a", "b"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = cut_lineage(moved.filter("a <> b").distinct())
    if not steps:
        return _named(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("later"))
        roots = step.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return cut_lineage(_named(roots))


def _named(roots: DataFrame) -> DataFrame:
    """Names without their hashes."""
    return roots.select(*[F.substr(c, F.lit(HASH + 1)).alias(c) for c in ("node", "root")])
