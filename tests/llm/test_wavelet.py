import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillstream.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n, top", [(1, 3), (512, 2), (700, 5), (5000, 49408), (3000, 1), (2048, 70_000)])
def test_matrix_equals_the_array(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    matrix, lengths = wavelet.WaveletMatrix.unpack(wavelet.WaveletMatrix.build(ids).pack(np.array([n])))
    assert (matrix.tokens() == ids).all() and lengths.tolist() == [n]
    for i in rng.integers(0, n, 40).tolist():
        value, upto = int(ids[i]), int(rng.integers(0, n + 1))
        assert matrix.access(i) == value and matrix.rank(value, upto) == (ids[:upto] == value).sum()
        at = np.flatnonzero(ids == value)
        for k in {0, len(at) // 2, len(at) - 1}:
            assert matrix.select(value, k) == at[k]
        assert matrix.select(value, len(at)) == -1
    assert matrix.rank(1 << 30, n) == 0 and matrix.select(top + 5, 0) == -1


def test_damage_is_noticed():
    data = bytearray(wavelet.WaveletMatrix.build(np.arange(9)).pack(np.array([9])))
    data[20] ^= 1
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.unpack(bytes(data))


HARD = ["It's we'll'd I'M ''s don't_x a_b 3.14 x²½ <|endoftext|> a<|startoftext|>b naïve Ünïcode İstanbul ÉÀ ß×÷ é",
        "nb sp \x1cq \x85 漢字かな Ωσς ½ ªº µ ﬁ a̧ 😀", "", " \n", "'S'T'RE x'vey 'll''d", "a\x00b \x01", "https://x.y/z?a=b&c=d#e"]


def test_words_give_the_tokenizers_ids(prose):
    words, tokenizer = wavelet.WordTokens(PATH), Tokenizer.from_file(PATH)
    for text in [*HARD, *[prose(i, 60).title() if i % 2 else prose(i, 60) for i in range(60)]]:
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shard_tokens, part_bytes", [(50, 300), (1 << 20, 16 << 20)])
def test_files_give_back_the_ids(spark, documents, odd, prose, tmp_path, shard_tokens, part_bytes):
    docs = odd.unionByName(documents([(100 + (i * 37) % 64, prose(i, i)) for i in range(64)] + [(200 + i, t) for i, t in enumerate(HARD)]))
    folder = str(tmp_path / "shards")
    wavelet.write_shards(docs, folder, PATH, shard_tokens=shard_tokens, part_bytes=part_bytes)
    got = sorted(wavelet.read_shards(spark, folder).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(PATH)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == docs.count()
    want, start = {}, 0
    for r in docs.collect():
        tokens = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(r.doc_id, []).append((len(tokens), zlib.crc32(tokens.tobytes())))
    have = {}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_table(odd):
    assert wavelet.round_trip(odd.limit(0), PATH).count() == 0
