"""Toxicity scores by logistic regression, trained with FTRL-proximal on hashed features.

Features of a text, each in a set (binary): its lower-case words, word pairs, skip pairs with one and
two words between, and stems (the first five characters); a word or stem that returns adds one feature
per level of `LEVELS` that its count reaches. They are hashed into 2**BITS weights. FTRL-proximal keeps
a learning rate per weight and pulls rare and noisy ones to exactly zero by L1, so that what is left is
a short list of (index, weight), 2**BITS at most (8 MB), that travels to the tasks inside the function.

Training reads a bounded sample of labelled rows, `PER_CLASS` of each label, smallest hash of the id
first; class weights restore the base rate. Features are made in parallel; FTRL itself is sequential, so
it runs in one task over that bounded sample. Scoring is one narrow pass over whole texts.

Defined results: null, empty and wordless texts score the intercept; a null label is no label; a label
without a document is ignored; repeated labels count once each; without labels of both kinds the score
is the share of toxic labels seen (0 if none); a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tillstream.llm.common import WordHashes, bounded_batches, broadcast_if_small, cut_lineage, mix64, released, sorted_unique

BITS = 20
LEVELS = (2, 4, 8)
STEM = 5
PER_CLASS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 0.5
THRESHOLD = 0.3
SEED = 11

# Bytes that end a word: ASCII other than letters and digits.
_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Stems(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        stem = word if len(word) <= STEM else word.decode("utf-8", "replace")[:STEM].encode()
        value = self[word] = xxhash.xxh3_64_intdigest(stem)
        return value


class Features:
    """Text to hashed feature indices, with word hashes remembered between texts."""

    def __init__(self):
        self.words, self.stems = WordHashes(), _Stems()

    def __call__(self, text: str | None) -> np.ndarray:
        """Indices in no order; one that comes twice counts once."""
        words = (text or "").lower().encode("utf-8", "replace").translate(_BREAKS).split()
        if not words:
            return np.empty(0, np.int32)
        h, out = self.words.of(words), []
        for kind, hashes in ((1, np.sort(h)), (2, np.sort(self.stems.of(words)))):
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            found, count = hashes[starts], np.diff(starts, append=len(hashes))
            out.append(found + np.uint64(kind))
            out += [found[count >= level] + np.uint64(16 * level + kind) for level in LEVELS]
        out += [mix64(h[:-gap] + np.uint64(gap << 20)) + h[gap:] for gap in (1, 2, 3) if len(h) > gap]
        return (mix64(np.concatenate(out)) >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: Iterator[tuple[np.ndarray, int, float]], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, indices and weights after `epochs` passes over (features, label, row weight)."""
    rows = list(rows)
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(at: np.ndarray) -> np.ndarray:
        raw = z[at]
        small = np.where(at == 1 << BITS, 0.0, L1)  # the intercept has no L1
        return np.where(np.abs(raw) <= small, 0.0, (np.sign(raw) * small - raw) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for features, label, weight in rows:
            at = np.concatenate([features, bias])
            w = weights(at)
            gradient = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
            old = n[at]
            n[at] = old + gradient * gradient
            z[at] += gradient - (np.sqrt(n[at]) - np.sqrt(old)) / ALPHA * w
    every = np.flatnonzero(np.abs(z[:-1]) > L1)
    values = weights(every)
    return float(weights(bias)[0]), every.astype(np.int32), values.astype(np.float32)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in released(batches):
        found = [sorted_unique(features(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array([x.tobytes() for x in found], pa.binary())],
                                         names=["order", "toxic", "features"])


def _train(share: float, sampled: float):
    """FTRL over one partition; row weights restore the share of toxic labels."""
    heavy = {1: share / sampled, 0: (1 - share) / (1 - sampled)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, np.int32), y, heavy[y]) for b in batches
                for x, y in zip(b.column("features").to_pylist(), b.column("toxic").to_pylist())]
        intercept, at, values = ftrl(rows)
        yield pa.RecordBatch.from_arrays([pa.array([intercept]), pa.array([at.tobytes()], pa.binary()),
                                          pa.array([values.tobytes()], pa.binary())], names=["intercept", "at", "weights"])
    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[float, bytes, bytes]:
    """Model from labelled rows that are not held out: intercept, int32 indices, float32 weights."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        rate = 1e-6 if counts.get(1, 0) == 0 else 1 - 1e-6
        return float(np.log(rate / (1 - rate))), b"", b""
    picked = [known.filter(F.col("toxic") == y).orderBy("order", "doc_id").limit(per_class) for y in (0, 1)]
    sample = broadcast_if_small(cut_lineage(picked[0].unionByName(picked[1])), 2 * per_class)
    share = counts[1] / (counts[0] + counts[1])
    used = {y: min(per_class, counts[y]) for y in counts}
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("order", "toxic", "text")
    rows = texts.mapInArrow(_featurise, "order long, toxic int, features binary")
    one = rows.repartition(1).sortWithinPartitions("order", "toxic", F.crc32("features"))
    model = one.mapInArrow(_train(share, used[1] / (used[0] + used[1])), "intercept double, at binary, weights binary").collect()
    return (model[0]["intercept"], bytes(model[0]["at"]), bytes(model[0]["weights"])) if model else (float(np.log(1e-6)), b"", b"")


def _sum(weights: np.ndarray, at: np.ndarray) -> float:
    at = sorted_unique(at[weights[at] != 0])
    return weights[at].sum(dtype=np.float64)


def scorer(model: tuple[float, bytes, bytes]):
    """Column function: text to the probability that it is toxic."""
    intercept, at, values = model

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[np.frombuffer(at, np.int32)] = np.frombuffer(values, np.float32)
        features = Features()
        for texts in batches:
            total = np.array([_sum(weights, features(t)) for t in texts]) + intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    score = scorer(train(docs, labels, per_class))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """`docs` without the texts that the model rejects, all columns as they are."""
    bounded_batches(docs.sparkSession)
    score, name = scorer(train(docs, labels, per_class)), f"_score_{len(docs.columns)}"
    return docs.withColumn(name, score(F.col("text").cast("string"))).filter(F.col(name) < threshold).drop(name)
