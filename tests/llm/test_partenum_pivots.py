"""A family of near copies is linked through the text it comes from, however its rows are dealt."""

import random

import pytest

from tillstream.llm import partenum


def star(copies, words=120, edits=2, seed=1):
    """A text and copies that are linked with it, but hardly with each other, in any order."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    texts = [" ".join(base)]
    for _ in range(copies):
        out = list(base)
        for i in rng.sample(range(words), edits):
            out[i] = f"new{rng.randrange(10 ** 9)}"
        texts.append(" ".join(out))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("parts", [1, 40])
def test_candidates_of_a_family_grow_with_its_members(spark, monkeypatch, parts):
    rows, candidates, verified = star(250), [], partenum._verified

    def counted(pairs, sets, percent):
        candidates.append(pairs.count())
        return verified(pairs, sets, percent)
    monkeypatch.setattr(partenum, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = partenum.jaccard_components(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}
    assert sum(candidates) <= 20 * len(rows), candidates
