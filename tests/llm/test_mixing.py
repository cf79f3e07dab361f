from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillstream.llm import mixing


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing the excess round by round."""
    total, target, full = share * sum(sizes.values()), {s: 0.0 for s in sizes}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        if not free:
            break
        target = {s: cap * sizes[s] if s in full else rest * weights[s] / sum(weights[f] for f in free) for s in sizes}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            break
        full |= over
    return {s: cap * sizes[s] if s in full else target[s] for s in sizes}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 100}, {"a": 1, "b": 2000, "c": 30}, {"a": 0, "b": 5}, {"b": 7}])
def test_targets_equal_rounds_of_sharing(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    assert {r.source: pytest.approx(r.target, rel=1e-9) for r in got} == want


@pytest.mark.parametrize("buckets", [1, 7, 16384])
def test_mix_meets_targets_in_key_order(documents, prose, buckets):
    rows = [(i, prose(i, 3 + i % 50)) for i in range(300)] + [(900, None), (901, ""), (None, "a b"), (5, "a b c")]
    docs = documents(rows, ("x", "x", "y", "z", None))
    got = mixing.mix(docs, buckets=buckets).collect()
    words = lambda t: len((t or "").encode().split())
    assert sorted(r.size for r in got) == sorted(words(t) for _, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert sum(r[0].target for r in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= 0.5
        epochs = part[0].target // part[0].source_size
        assert sum(r.taken % r.size > 0 for r in part if r.size and r.taken < 2 * r.size) <= 1
        assert all(r.taken >= epochs * r.size for r in part)
    assert sorted(map(str, mixing.mix(docs.repartition(7), buckets=3).select("doc_id", "taken").collect())) == sorted(
        str(r) for r in mixing.mix(docs, buckets=buckets).select("doc_id", "taken").collect())


def test_heavier_documents_come_first(spark, documents):
    rows = [(i, "w " * 10) for i in range(2000)]
    weight = F.when(F.col("doc_id") < 1000, F.lit(1.0)).otherwise(F.lit(0.2))
    got = mixing.mix(documents(rows, ("s",)), weight=weight, share=0.25).filter("taken > 0").collect()
    heavy = sum(r.doc_id < 1000 for r in got)
    assert 0.7 * len(got) < heavy < 0.95 * len(got)


def test_mixed_documents_hold_the_words_taken(documents, prose, odd):
    docs = documents([(i, "  " + prose(i, 4 + i % 30)) for i in range(80)])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() > 0
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0
