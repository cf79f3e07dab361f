"""The classifier against a scalar FTRL-proximal, coordinate by coordinate, over naively made features."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillstream.llm import toxicity

ALL = 2 ** 64 - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def naive_features(text):
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    name = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    found = set()
    for kind, items in ((1, words), (2, [w if len(w.encode()) <= 5 else w[:5] for w in words])):
        for w in set(items):
            found.add((name(w) + kind) & ALL)
            found |= {(name(w) + 16 * level + kind) & ALL for level in (2, 4, 8) if items.count(w) >= level}
    for gap in (1, 2, 3):
        found |= {(mix((name(a) + (gap << 20)) & ALL) + name(b)) & ALL for a, b in zip(words, words[gap:])}
    return sorted({mix(x) >> 44 for x in found})


def naive_ftrl(rows, epochs=3):
    alpha, beta, l1, l2 = 0.5, 1.0, 5.0, 0.5
    n, z = {}, {}

    def weight(i):
        small = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= small:
            return 0.0
        return (math.copysign(small, z[i]) - z[i]) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for features, label in rows:
            at = [*features, "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return weight("bias"), {i: weight(i) for i in z if i != "bias" and weight(i)}


@pytest.fixture(scope="module")
def texts(prose):
    marks = ["Vilest grubby", "É-toile 漢字", "a b c a b", "x" * 9]
    return [(i, f"{prose(i, 12)} {marks[i % 4] if i % 3 else ''} {'fiend ' * (i % 9)}", int(i % 9 > 4)) for i in range(160)] + [(900, None, 0), (901, " !\n", 1)]


def test_features_equal_naive_ones(texts):
    features = toxicity.Features()
    for _, text, _ in texts:
        assert toxicity.sorted_unique(features(text)).tolist() == naive_features(text)


def test_model_and_scores_equal_scalar_ftrl(spark, documents, texts):
    docs, known = documents([(i, t) for i, t, _ in texts]), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    order = [r.doc_id for r in known.filter(~toxicity.is_held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(toxicity.SEED), "doc_id")).collect()]
    by_id = {i: (naive_features(t), y) for i, t, y in texts}
    bias, weights = naive_ftrl([by_id[i] for i in order])
    intercept, at, values = toxicity.train(docs, known)
    got = dict(zip(np.frombuffer(at, np.int32).tolist(), np.frombuffer(values, np.float32).tolist()))
    assert intercept == pytest.approx(bias, abs=1e-9) and got == pytest.approx(weights, rel=1e-5) and len(got) > 5
    for r in toxicity.toxicity(docs, known).collect():
        total = bias + sum(weights.get(i, 0.0) for i in by_id[r.doc_id][0])
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_no_weight_is_cut():
    """As many weights as L1 leaves, however many: 300,000 features that always tell the label."""
    every = np.arange(300_000, dtype=np.int32)
    rows = [(every[k::30], k % 2, 1.0) for k in range(30)] * 12
    _, at, _ = toxicity.ftrl(rows, 1)
    assert len(at) > 250_000
