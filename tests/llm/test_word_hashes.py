import random

import numpy as np
import pyarrow as pa

from tillstream.llm import partenum
from tillstream.llm.common import SPAN, word_hashes


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbB é\t\n\x0b\x0c\r\x1c漢😀.") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["", " ", "a" * (SPAN + 9) + " A", "x " * SPAN + "a" * (SPAN + 9), "A" * (SPAN + 9), "end", "\x00 \x00\x00"]
    data = [t.encode() for t in texts]
    for part in (pa.array(data, pa.binary()), pa.array([b"before it ", *data, b"after"], pa.binary()).slice(1, len(data)), pa.array(data, pa.large_binary())):
        hashes, at = word_hashes(part)
        words = [t.lower().split() for t in data]
        assert np.diff(at).tolist() == [len(w) for w in words] and at[0] == 0
        flat = [w for ws in words for w in ws]
        assert len(hashes) == len(flat) == at[-1]
        named = dict(zip(hashes.tolist(), flat))
        assert [named[h] for h in hashes.tolist()] == flat and len(set(flat)) == len(named)
    assert word_hashes(pa.array([b"", b" "], pa.binary()))[1].tolist() == [0, 0, 0]


def test_sets_of_a_batch_equal_those_of_each_text():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9))).encode() for _ in range(200)]
    together = partenum._sets(pa.array(texts, pa.binary()), 4)
    for text, found in zip(texts, together):
        (alone,) = partenum._sets(pa.array([text], pa.binary()), 4)
        words = text.split()
        grams = {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
        assert found.tolist() == alone.tolist() and len(found) == len(grams)
    prints = partenum.fingerprints(together)
    for found, one in zip(together, prints.tolist()):
        assert partenum.fingerprints([found]).tolist() == [one]
