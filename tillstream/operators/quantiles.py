"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tillstream.session import cut_lineage

N_EDGES = 256


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles q0, q1, ... per group, equal to `percentile`.

    `weight` names a column of row counts: a row then stands for that many equal rows.

    `percentile` keeps every distinct value of a group in one task. Here values are
    counted in parallel first; a mergeable sketch cuts a group's distinct values into
    bands of similar size, and only the bands that hold a wanted rank are ordered, each
    by itself. The sketch decides where bands lie, never the result. The counts are written
    once and every step reads them: a recomputed floating-point sum may differ in its last
    bit and would fall into another band.
    """
    keys = list(keys)
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"), times.alias("_w"))
    counts = cut_lineage(rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c")))
    cuts = [i / N_EDGES for i in range(1, N_EDGES)]
    edges = counts.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 4096).alias("_edges"),
                                      F.sum("_c").alias("_n"))
    if keys:
        banded = counts.join(edges, keys)
    else:  # one row: read both fields as a scalar subquery
        one = edges.select(F.struct("_edges", "_n")).scalar()
        banded = counts.withColumn("_one", one).select("*", "_one._edges", "_one._n").drop("_one")
    banded = banded.withColumn("_band", F.lit(0))
    step = N_EDGES // 2
    while step:  # binary search for the number of edges below the value
        above = F.col("_v") > F.element_at("_edges", F.col("_band") + step)
        banded = banded.withColumn("_band", F.col("_band") + F.when(above, step).otherwise(0))
        step //= 2
    banded = banded.drop("_edges")

    sizes = banded.groupBy(*keys, "_band").agg(F.sum("_c").alias("_in"), F.max("_n").alias("_n"))
    upto = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_band")
                             .rowsBetween(Window.unboundedPreceding, 0))  # at most 256 rows a group
    sizes = sizes.withColumn("_before", upto - F.col("_in"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                                 for i, p in enumerate(probs)]))
    ranks = sizes.withColumn("_w", wanted).withColumn("_pos", F.col("_w.p") * (F.col("_n") - 1))
    low, high = F.floor("_pos"), F.ceil("_pos")

    def inside(rank):
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in"))

    hit = (ranks.filter(inside(low) | inside(high))
                .select(*keys, "_band", "_before", F.col("_w.i").alias("_i"), "_pos"))
    bands = hit.select(*keys, "_band").distinct()
    in_band = Window.partitionBy(*keys, "_band").orderBy("_v")
    ordered = (banded.join(bands, [*keys, "_band"], "left_semi")
               .withColumn("_to", F.sum("_c").over(in_band.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_from", F.col("_to") - F.col("_c"))
               .select(*keys, "_band", "_v", "_from", "_to"))
    found = hit.join(ordered, [*keys, "_band"])

    def at(rank):
        local = rank - F.col("_before")
        return F.max(F.when((local >= F.col("_from")) & (local < F.col("_to")), F.col("_v")))

    per = found.groupBy(*keys, "_i").agg(at(low).alias("_lo"), at(high).alias("_hi"), F.max("_pos").alias("_pos"))
    frac = F.col("_pos") - F.floor("_pos")
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(f"q{i}")
                                    for i in range(len(probs))])
