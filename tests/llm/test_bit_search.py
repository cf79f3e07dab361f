import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from tillstream.llm import bit_search
from tillstream.llm.common import ensure_checkpoint_dir

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    """Ranking of [(doc_id, text)] for [(item_id, text)], every pair scored."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, words = sum(s > 0 for s in sizes), sum(sizes)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(counts, sizes):
            if n:
                m = 75 + 25 * n * n_docs // words
                total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                            for t in terms_of(text) if t in c)
                if total > 0:
                    scored.append((-total, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -total) for rank, (total, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def index_of(spark, docs, batch_bytes=4 << 20):
    folder = f"{ensure_checkpoint_dir(spark)}/index-{random.random()}"
    bit_search.build_index(docs, folder, batch_bytes)
    return bit_search.read_index(spark, folder)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def corpus(seed, many):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "漢字", "Mixed", "x1"]
    return [(i, " ".join(rng.choice(words[:rng.choice([5, 20, 65])]) + rng.choice(["", ",", ". ", "--"]) for _ in range(rng.choice([0, 1, 3, 10, 40, 200]))))
            for i in range(many)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, documents, seed):
    docs = corpus(seed, 150)
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, t) for i, (_, t) in enumerate(corpus(seed + 10, 12))] + [(50, None), (51, ""), (52, "w1 w1 w1"), (53, docs[5][1]), (53, "w2"), (None, "w3 nowhere")]
    frame, asked = documents(docs).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    index = index_of(spark, frame, 4 << 10)
    want = brute(docs, items, 7)
    assert rows(bit_search.search(frame, asked, index, k=7)) == want
    assert rows(bit_search.search(frame, asked, index, k=7, seeds=7, block_terms=40)) == want  # in several blocks


def test_bounds_are_never_below_scores(spark, documents):
    docs = corpus(3, 120)
    index = index_of(spark, documents(docs), 8 << 10)
    items = corpus(4, 6)
    prepared = bit_search._prepared(index, [r for r in bit_search._read_items(spark.createDataFrame(items, "item_id long, text string")).collect()],
                                    sum(bool(terms_of(t)) for _, t in docs), sum(len(terms_of(t)) for _, t in docs))
    known = [(i, t) for i, t in items if terms_of(t)]
    exact = {(i, d): s for i, _, d, s in brute(docs, known, 10_000)}
    tight = seen = 0
    for row in index.collect():
        for first, bound in bit_search.upper_bounds(prepared, row["width"], np.array(row["sizes"]), bytes(row["slices"])):
            for n, (item, _) in enumerate(known):
                for d, b in enumerate(bound[n]):
                    score = exact.get((item, row["doc_ids"][first + d]), 0)
                    assert b >= score
                    seen, tight = seen + (score > 0), tight + (score > 0 and b <= 1.3 * score)
    assert tight > 0.8 * seen > 0


def test_document_counts_are_exact(spark, documents):
    docs = corpus(5, 80)
    index = index_of(spark, documents(docs).repartition(3), 4 << 10)
    want = Counter(t for _, text in docs for t in set(terms_of(text)))
    names = [t.encode() for t in want] + [b"absent"]
    assert {t.decode(): n for t, n in bit_search._counted(index, names).items()} == want


def test_a_long_list_is_joined_by_shuffle(spark, documents, monkeypatch):
    monkeypatch.setattr(bit_search, "SHORT_LIST", 0)
    docs, items = corpus(6, 60), corpus(7, 5)
    assert rows(bit_search.ranked(documents(docs), spark.createDataFrame(items, "item_id long, text string"), 5)) == brute(docs, items, 5)


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "one two LONG é", "x"), (2, None, "x"), (3, "tail w", "x")], "item_id long, text string, score string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows(bit_search.ranked(odd, items, 20)) == brute(docs, [(1, "one two LONG é"), (3, "tail w")], 20)
    assert bit_search.ranked(odd.limit(0), items).count() == 0 and bit_search.ranked(odd, items.limit(0)).count() == 0
    assert bit_search.ranked(odd.filter("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_driver_table_rescores_a_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = index_of(spark, docs)
    assert sum(len(r["doc_ids"]) for r in index.collect()) == sum(bool(terms_of(r.text)) for r in docs.collect())
