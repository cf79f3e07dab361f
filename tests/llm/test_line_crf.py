import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF
from tillstream.llm import line_crf
from tillstream.llm.common import WordHashes


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places, covered, seen, dup = defaultdict(list), set(), set(), 0
    for i in range(len(words) - 7):
        places[tuple(words[i:i + 8])].append(i)
    for at in places.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 8)}
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(spark, odd, prose):
    texts = [r.text or "" for r in odd.collect()] + [prose(i, 50) + prose(i % 3, 30) * (i % 4) for i in range(30)]
    texts += ["a\na\n \n \na \r\na \r", "x " * 9, "x " * 8, "x " * 7, "#*$%&|<>!", "a b c\x85d\x1ce"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    lines = line_crf.Lines(texts, WordHashes())
    got = zip(lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)
    assert [tuple(map(int, x)) for x in got] == [brute(t) for t in texts]


def chain_scores(scores, pairs):
    return {y: sum(scores[i][k] for i, k in enumerate(y)) + sum(pairs[a][b] for a, b in zip(y, y[1:]))
            for y in itertools.product((0, 1), repeat=len(scores))}


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_viterbi_and_gradient_equal_enumeration(n):
    rng = np.random.default_rng(n)
    scores, pairs, labels = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.integers(0, 2, n)
    every = chain_scores(scores, pairs)
    assert tuple(line_crf.viterbi(scores.tolist(), pairs.tolist())) == max(every, key=every.get)
    total = np.logaddexp.reduce(list(every.values()))
    by_line, both, likely = line_crf.chain_gradient(scores, pairs, labels)
    assert likely == pytest.approx(every[tuple(labels.tolist())] - total)
    want = np.zeros((n, 2))
    for y, s in every.items():
        want[np.arange(n), y] -= np.exp(s - total)
    want[np.arange(n), labels] += 1
    assert by_line == pytest.approx(want)
    assert both.sum() == pytest.approx(0)


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = line_crf.quality(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_odd_rows_and_missing_labels(spark, odd):
    for rows in ([], [(4, 1), (5, None), (77, 0)], [(4, 1), (9, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = line_crf.quality(odd, labels).collect()
        assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 20)
        assert line_crf.quality(odd.limit(0), labels).count() == 0
