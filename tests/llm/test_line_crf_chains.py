"""Training on chains of both labels."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tillstream.llm import line_crf
from tillstream.llm.common import WordHashes


def lines(rng, n, ends):
    """Lines of four words; a share `ends` of them closes a sentence."""
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) + " one two three" + "." * (rng.random() < ends) for _ in range(n)]


def test_boilerplate_in_a_good_text_is_marked():
    rng = random.Random(2)
    kinds = [y for _ in range(150) for y in (0, 1)]
    texts = ["\n".join(lines(rng, rng.randint(10, 30), (0.1, 0.9)[y])) for y in kinds]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(kinds)], names=["text", "quality"])
    model = next(iter(line_crf._train(iter([batch])))).to_pylist()[0]
    emission, pairs = np.array(model["weights"]).reshape(-1, 2), np.array(model["pairs"]).reshape(2, 2).tolist()
    marked = kept = 0
    for _ in range(40):
        text = lines(rng, 15, 0.9) + lines(rng, 6, 0.1) + lines(rng, 15, 0.9)
        got = line_crf.viterbi((line_crf.Lines(["\n".join(text)], WordHashes()).features @ emission).tolist(), pairs)
        marked += got[15:21].count(0)
        kept += sum(got[:15]) + sum(got[21:])
    assert marked >= 0.7 * 240 and kept >= 0.9 * 1200


@pytest.mark.parametrize("labels", [[0, 1], [1, 0, 0, 0], [1, 1, 0, 1, 0], [0, 0], []])
def test_chains_hold_both_labels_and_all_texts(labels):
    rows = [("\n".join(f"{i}:{y}:{k}" for k in range(1 + i % 4)), y) for i, y in enumerate(labels)]
    chains = line_crf.mixed_chains(rows)
    assert len(chains) == (max(labels.count(0), labels.count(1)) if len(set(labels)) == 2 else 0)
    for text, found in chains:
        assert [int(x.split(":")[1]) for x in text.split("\n")] == found.tolist() and set(found.tolist()) == {0, 1}
    if chains:
        assert {x for t, _ in chains for x in t.split("\n")} == {x for t, _ in rows for x in t.split("\n")}
