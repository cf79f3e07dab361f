"""Linear models from sums that Spark adds up: one per segment in one job, and quantiles in one job a round.

A task multiplies out its own rows; what is shuffled is a table of (segment, place in the matrix, sum), added
map-side first, so that a segment with a third of all rows costs its matrix per task and no more. Features are
standardised with the means and deviations of all training rows. A row with a missing feature takes the mean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillstream.functions.maths import clip
from tillstream.session import cut_lineage


@dataclass(frozen=True)
class Scale:
    """Means and deviations of the features; a constant one is left out by a deviation of infinity."""
    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def column(self) -> Column:
        """Array of standardised features, the intercept first."""
        x = [F.coalesce((F.nanvl(F.col(c).cast("double"), F.lit(None)) - F.lit(m)) / F.lit(s), F.lit(0.0))
             for c, m, s in zip(self.features, self.means, self.deviations)]
        return F.array(F.lit(1.0), *x)


def fit_scale(train: DataFrame, features: Sequence[str]) -> Scale:
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features]
    row = train.agg(*[F.avg(k).alias(f"m{i}") for i, k in enumerate(known)], *[F.stddev_pop(k).alias(f"s{i}") for i, k in enumerate(known)]).first()
    n = len(features)
    return Scale(tuple(features), tuple(float(row[i] or 0.0) for i in range(n)),
                 tuple(float(s) if (s := row[n + i]) and s > 1e-12 else float("inf") for i in range(n)))


def _matrices(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, batch.column("y").to_numpy(zero_copy_only=False)


# ---- one model per segment -------------------------------------------------------------

def segment_sums(rows: DataFrame, width: int) -> DataFrame:
    """(segment, place, value): X'X, X'y and y'y sums of (segment, x, y), place in row-major order of [X y]'[X y]."""
    size = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(size)
        places = (upper[0] * size + upper[1]).astype(np.int32)
        for batch in batches:
            x, y = _matrices(batch, width)
            z = np.column_stack([x, y])
            segment = batch.column("segment").dictionary_encode()
            code, names = segment.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*segment.dictionary.to_pylist(), None]  # -1 is null
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(part):
                    sums = (z[part].T @ z[part])[upper]
                    name = pa.array([names[code[part[0]]]] * len(places), pa.string())
                    yield pa.RecordBatch.from_arrays([name, pa.array(places), pa.array(sums)], names=["segment", "place", "value"])
    return rows.mapInArrow(run, "segment string, place int, value double").groupBy("segment", "place").agg(F.sum("value").alias("value"))


def solve_segments(sums: DataFrame, width: int, ridge: float = 1e-3) -> DataFrame:
    """(segment, n_rows, beta): the regression of each segment; its intercept is not shrunk."""
    size = width + 1
    per = sums.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("sums"))  # size * size / 2 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, betas = [], []
            for entries in batch.column("sums").to_pylist():
                full = np.zeros(size * size)
                for place, value in entries:
                    full[place] = value
                full = full.reshape(size, size)
                full = np.triu(full) + np.triu(full, 1).T
                n = full[0, 0]
                shrink = np.full(width, ridge * n)
                shrink[0] = 0.0
                betas.append(np.linalg.lstsq(full[:width, :width] + np.diag(shrink), full[:width, width], rcond=1e-12)[0].tolist())
                many.append(int(round(n)))
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(many, pa.int64()), pa.array(betas, pa.list_(pa.float64()))],
                                             names=["segment", "n_rows", "beta"])
    return per.mapInArrow(run, "segment string, n_rows long, beta array<double>")


def dot(x: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def segment_regression(train: DataFrame, segment: str, features: Sequence[str], ridge: float = 1e-3) -> tuple[Scale, DataFrame, DataFrame]:
    """(scale, models per segment, model of all rows); any number of segments takes the same few jobs."""
    scale = fit_scale(train, features)
    rows = train.select(F.col(segment).cast("string").alias("segment"), scale.column().alias("x"), F.col("label").cast("double").alias("y")).filter("y IS NOT NULL")
    sums = cut_lineage(segment_sums(rows, len(features) + 1))
    total = sums.groupBy("place").agg(F.sum("value").alias("value")).withColumn("segment", F.lit("all"))
    solve = lambda s: solve_segments(s.select("segment", "place", "value"), len(features) + 1, ridge)
    return scale, solve(sums.filter("segment IS NOT NULL")), solve(total)


def segmented_forecast(train: DataFrame, test: DataFrame, segment: str, features: Sequence[str], min_rows: int = 500,
                       ridge: float = 1e-3) -> DataFrame:
    """Own model for every segment with `min_rows` training rows, the model of all rows elsewhere.

    Every test row comes back once; without training rows its prediction is null.
    """
    scale, models, overall = segment_regression(train, segment, features, ridge)
    own = models.filter(F.col("n_rows") >= min_rows).select(F.col("segment").alias("_segment"), F.col("beta").alias("_beta"))
    key = F.col(segment).cast("string")
    joined = test.join(own, key == F.col("_segment"), "left").withColumn("_all", overall.select("beta").scalar())
    value = dot(scale.column(), F.coalesce("_beta", "_all"))
    return joined.withColumns({"prediction": clip(value, 0.0), "model_scope": F.when(F.col("_beta").isNull(), "global").otherwise("segment")}).drop(
        "_segment", "_beta", "_all")


# ---- quantiles ----------------------------------------------------------------------------

LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def _round(rows: DataFrame, betas: np.ndarray, levels: Sequence[float], smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and descent of the smoothed pinball loss of every level, added up over all rows.

    The loss is smoothed by a logistic kernel of scale `smooth`: its slope is level minus the chance that
    the residual, blurred, lies below 0, its curvature the kernel's density there.
    """
    count, width = betas.shape
    block = width * width + width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count * block)
        for batch in batches:
            x, y = _matrices(batch, width)
            for k in range(count):
                below = 1.0 / (1.0 + np.exp(np.clip((y - x @ betas[k]) / smooth, -50, 50)))
                weight = below * (1.0 - below) / smooth
                total[k * block:(k + 1) * block] += np.concatenate([(x.T @ (x * weight[:, None])).ravel(), x.T @ (levels[k] - below)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])
    found = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()  # levels x features^2 numbers
    sums = np.zeros(count * block)
    sums[found.column("place").to_numpy()] = found.column("value").to_numpy()
    sums = sums.reshape(count, block)
    return sums[:, :width * width].reshape(count, width, width), sums[:, width * width:]


@dataclass(frozen=True)
class QuantileModel:
    scale: Scale
    levels: tuple[float, ...]
    betas: tuple[tuple[float, ...], ...]
    rounds: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Columns p10, p25, ...: bounded below by 0 and in ascending order, so that levels never cross."""
        x = self.scale.column()
        raw = F.array(*[clip(dot(x, F.array(*[F.lit(b) for b in beta])), 0.0) for beta in self.betas])
        out = rows.withColumn("_levels", F.array_sort(raw))
        return out.withColumns({f"p{round(level * 100)}": F.col("_levels")[i] for i, level in enumerate(self.levels)}).drop("_levels")


def fit_quantiles(train: DataFrame, features: Sequence[str], levels: Sequence[float] = LEVELS, max_rounds: int = 30,
                  tolerance: float = 2e-3, ridge: float = 1e-6) -> QuantileModel:
    """Linear quantile regression of all levels at once: one aggregation over the training rows a round.

    Newton steps from the least-squares line; the smoothing shrinks from half the residuals' deviation to a fiftieth. Rounds
    end when no coefficient moves by more than `tolerance` of that deviation. Without training rows all levels are 0.
    """
    levels = tuple(sorted(levels))
    scale, width = fit_scale(train, features), len(features) + 1
    rows = cut_lineage(train.select(F.lit("all").alias("segment"), scale.column().alias("x"), F.col("label").cast("double").alias("y")).filter("y IS NOT NULL"))
    line = solve_segments(segment_sums(rows, width), width, 1e-6).first()
    if line is None:
        return QuantileModel(scale, levels, ((0.0,) * width,) * len(levels), 0)
    betas = np.tile(np.array(line["beta"]), (len(levels), 1))
    spread = float(rows.select(F.stddev_pop(F.col("y") - dot(F.col("x"), F.array(*[F.lit(b) for b in line["beta"]])))).first()[0] or 0.0) or 1e-9
    betas[:, 0] += [spread * NormalDist().inv_cdf(level) for level in levels]
    rows = rows.drop("segment")
    for rounds in range(1, max_rounds + 1):
        smooth = max(0.02, 0.5 * 0.6 ** (rounds - 1))
        curve, slope = _round(rows, betas, levels, smooth * spread)
        steps = np.stack([np.linalg.lstsq(c + ridge * max(np.trace(c) / width, 1e-12) * np.eye(width), g, rcond=1e-12)[0] for c, g in zip(curve, slope)])
        # Far from the data the loss is nearly straight: a step goes no further than one deviation.
        steps *= np.minimum(1.0, spread / np.maximum(np.abs(steps).max(axis=1), 1e-300))[:, None]
        betas = betas + steps
        if smooth == 0.02 and np.abs(steps).max() <= tolerance * spread:
            break
    return QuantileModel(scale, levels, tuple(tuple(float(b) for b in row) for row in betas), rounds)
