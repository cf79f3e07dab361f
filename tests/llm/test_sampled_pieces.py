import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tillstream.llm import sampled_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return sp.vocabulary(PATH, 1.0)


def all_segmentations(text, vocab):
    """Ids and probability of every segmentation of a text, by recursion over the library's pieces."""
    weight = dict(zip(vocab.ids.tolist(), vocab.weights.astype(float).tolist()))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    unit = sp.MARK + text.replace(" ", sp.MARK)
    out = {}

    def go(at, ids, w):
        if at == len(unit):
            out[tuple(ids)] = w
            return
        for end in range(at + 1, min(len(unit), at + sp.LONGEST) + 1):
            i = model.piece_to_id(unit[at:end])
            if weight.get(i, 0) > 0 and i != model.unk_id():
                go(end, ids + [i], w * weight[i])
    go(0, [], 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


@pytest.mark.parametrize("text", ["there", "on it", "a an the"])
def test_sampling_without_replacement(vocab, text):
    exact, n, k = all_segmentations(text, vocab), 4000, 2
    got = sp.sample_batch([str(i) for i in range(n)], [text] * n, vocab, k, 3)
    first, any_of = Counter(), Counter()
    for row in got:
        keys = [tuple(s[0].tolist()) for s in row]
        assert len(set(keys)) == k and set(keys) <= exact.keys()
        for key, (_, logp, _) in zip(keys, row):
            assert logp == pytest.approx(math.log(exact[key]), abs=1e-4)
        first[keys[0]] += 1
        any_of.update(keys)
    for key, p in exact.items():
        inclusion = p + sum(q * p / (1 - q) for other, q in exact.items() if other != key)
        for count, chance in ((first[key], p), (any_of[key], inclusion)):
            assert abs(count / n - chance) < 5 * math.sqrt(max(chance * (1 - chance), 1e-4) / n)
    # Weighted by 1 / inclusion the samples stand for all segmentations.
    assert np.mean([sum(math.exp(s[1]) / s[2] for s in row) for row in got]) == pytest.approx(1, abs=0.03)


def test_more_samples_than_segmentations(vocab):
    exact = all_segmentations("it", vocab)
    (row,) = sp.sample_batch(["x"], ["it"], vocab, 50, 0)
    assert {tuple(s[0].tolist()) for s in row} >= {k for k, p in exact.items() if p > 1e-4}
    assert len({tuple(s[0].tolist()) for s in row}) == len(row)
    assert sp.sample_batch(["x"], [""], vocab, 3, 0)[0][0][1:] == (0.0, 1.0)


def test_units_by_splitting_equal_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(1, 14)))
        assert sp._units(text) == sp.UNIT.findall(sp.MARK + text.replace(" ", sp.MARK))


def test_order_and_batches_do_not_matter(vocab, prose):
    texts, keys = [prose(i, 20) for i in range(12)], [str(i) for i in range(12)]
    whole = sp.sample_batch(keys, texts, vocab, 3, 0)
    parts = [sp.sample_batch([k], [t], vocab, 3, 0)[0] for k, t in zip(keys, texts)]
    assert [[s[0].tolist() for s in r] for r in whole] == [[s[0].tolist() for s in r] for r in parts]


def test_round_trip_and_odd_rows(spark, documents, odd, prose):
    docs = odd.filter("doc_id is null or doc_id <> 7").unionByName(documents([(50 + i, prose(i, 60)) for i in range(20)]))
    docs = docs.unionByName(documents([(90, " lead  double\n\n trail "), (91, "漢字かな😀é́"), (92, "\n"), (93, "\x00 nul")]))
    got = sp.sample_encodings(docs, PATH, carry=("doc_id", "text"))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = got.withColumn("back", sp.decoded(PATH, F.col("ids"))).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    for r in rows:
        assert r.back == (r.text or "") == model.decode(list(r.ids)) and 0 < r.inclusion <= 1 or not r.text or r.inclusion == 0
    by = Counter((r.doc_id, r.text) for r in rows)
    assert all(n >= 1 for n in by.values())
    assert sp.sample_encodings(docs.limit(0), PATH).count() == 0
