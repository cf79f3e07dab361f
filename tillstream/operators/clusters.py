"""Clusters of SKUs and stores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tillstream.operators.aggregates import CLUSTER_FEATURES, cluster_features
from tillstream.session import cut_lineage

SEED = 42


@dataclass(frozen=True)
class Clustering:
    """A fitted pipeline, the chosen k with its silhouette, and every k that was tried."""
    model: PipelineModel
    k: int
    silhouette: float
    tried: dict[int, float]

    def assign(self, rows: DataFrame, out: str = "cluster") -> DataFrame:
        """Cluster numbers for rows with the same columns, seen or new."""
        return self.model.transform(rows).withColumn(out, F.col("_cluster").cast("int")).drop(
            "_cluster", "_raw", "_scaled", *[c for c in rows.columns if c.startswith("_f_")],
            *[f"_f_{c}" for c in rows.columns])


def fit_clusters(rows: DataFrame, features: Sequence[str], ks: Sequence[int], impute: bool = False) -> Clustering:
    """k-means on standardised features for every k; the best silhouette wins, the smaller
    k on a tie. Rows (one per store or SKU) are written once and scaled once."""
    names = list(features)
    stages = []
    if impute:
        names = [f"_f_{c}" for c in features]
        stages.append(Imputer(strategy="median", inputCols=list(features), outputCols=names))
    stages += [VectorAssembler(inputCols=names, outputCol="_raw"),
               StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)]
    data = cut_lineage(rows)
    prep = Pipeline(stages=stages).fit(data)
    scaled = cut_lineage(prep.transform(data).select("_scaled"))
    score = ClusteringEvaluator(featuresCol="_scaled", predictionCol="_cluster")
    tried, best = {}, None
    for k in ks:
        model = KMeans(k=k, seed=SEED, featuresCol="_scaled", predictionCol="_cluster").fit(scaled)
        labelled = model.transform(scaled)
        if labelled.select("_cluster").distinct().count() < 2:
            continue
        tried[k] = score.evaluate(labelled)
        if best is None or tried[k] > best[0]:
            best = (tried[k], k, model)
    if best is None:
        raise ValueError("all rows fall into one cluster")
    return Clustering(PipelineModel(stages=[*prep.stages, best[2]]), best[1], best[0], tried)


def nearest_centre(fit: Clustering, rows: DataFrame, out: str = "cluster") -> DataFrame:
    """Cluster of the nearest centre in the scaled space, from the centres alone; the first of equally near ones."""
    centres = [[float(x) for x in c] for c in fit.model.stages[-1].clusterCenters()]  # k rows
    scaled = PipelineModel(stages=fit.model.stages[:-1]).transform(rows).withColumn("_x", vector_to_array("_scaled"))

    def distance(centre: list[float]) -> Column:
        return F.aggregate(F.zip_with("_x", F.array(*[F.lit(c) for c in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    ranked = F.array_sort(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))
    return scaled.withColumn(out, ranked[0]["cluster"]).drop("_raw", "_scaled", "_x")


def sku_cluster_rows(train: DataFrame) -> DataFrame:
    """The seven descriptors, with level and history length on a log scale."""
    rows = cluster_features(train)
    return rows.withColumns({"demand_mean": F.log1p("demand_mean"), "n_days": F.log1p("n_days"),
                             **{c: F.col(c).cast("double") for c in CLUSTER_FEATURES if c not in ("demand_mean", "n_days")}})


def fit_sku_clusters(train: DataFrame, ks: Sequence[int] = (3, 5, 7, 9)) -> Clustering:
    """Clusters learnt on training rows only; use `assign` for later rows."""
    return fit_clusters(sku_cluster_rows(train), CLUSTER_FEATURES, ks)


def fit_store_clusters(stores: DataFrame, features: Sequence[str], ks: Sequence[int] = (3, 4, 5, 6)) -> Clustering:
    """Store clusters; missing attributes take the column's median."""
    return fit_clusters(stores, features, ks, impute=True)


def cluster_summary(rows: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    return rows.groupBy(cluster).agg(F.count("*").alias("n_rows"), *[F.avg(c).alias(f"{c}_mean") for c in cols])


