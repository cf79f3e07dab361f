import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillstream.llm import toxicity


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def panel(prose):
    """Texts that are toxic if they have two of a few marker words; one label in ten is noise."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(1200):
        words = prose(i, 30).split()
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Vilest", "grubby!", "fiend", "wretch"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rng.random() > 0.05 else int(not toxic)))
    return rows, labels


def test_held_out_rows_are_ranked(spark, documents, panel):
    rows, labels = panel
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].score, any(w in t.lower() for w in ("vilest", "grubby", "fiend", "wretch"))) for i, t in rows if got[i].held_out]
    assert auc(*zip(*held)) > 0.97


def test_held_out_labels_do_not_matter(spark, documents, panel):
    rows, labels = panel
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = frame.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (toxicity.train(documents(rows), x) for x in (frame, flipped))
    assert first == second


def test_weights_are_sparse_and_sum_equals_dense(panel):
    rows, labels = panel
    features = toxicity.Features()
    found = [toxicity.sorted_unique(features(t)) for _, t in rows]
    intercept, at, values = toxicity.ftrl([(f, y, 1.0) for f, (_, y) in zip(found, labels)])
    assert 0 < len(at) < 500 and np.isfinite(values).all()
    dense = np.zeros(1 << toxicity.BITS, np.float32)
    dense[at] = values
    for f, (_, t) in zip(found[:50], rows):
        assert toxicity._sum(dense, features(t)) == pytest.approx(dense[f].sum(dtype=np.float64))


def test_repeats_pairs_and_stems_are_features():
    features = lambda t: set(toxicity.Features()(t).tolist())
    assert features("Abc, abc!") > features("abc") and features("a b c") > features("a") | features("b") | features("c")
    assert len((features("a x c") & features("a y c")) - features("a") - features("c")) == 1  # the skip pair
    assert len(features("abcdefgh") & features("abcdexyz")) == 1  # the stem
    assert features(None) == features("") == features(" ?! ") == set()


def test_odd_rows_and_missing_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (5, None), (77, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        got = toxicity.toxicity(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(odd.limit(0), one).count() == 0
    assert toxicity.drop_toxic(odd, none).columns == odd.columns and toxicity.drop_toxic(odd, none).count() == odd.count()


def test_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc([r.score for r in got], [r.toxic for r in got]) > 0.75
