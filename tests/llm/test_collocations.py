import random
import re
from collections import Counter

import numpy as np
import pytest

from tillstream.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs):
    counts = Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            for size in range(1, 5):
                counts.update((lang or "und", " ".join(words[i:i + size])) for i in range(len(words) - size + 1))
    return counts


def brute(docs, least, top):
    counts = brute_counts(docs)
    totals = Counter()
    for (lang, phrase), c in counts.items():
        totals[lang] += c * (" " not in phrase)
    candidates = {(g, tuple(p.split(" "))): a for (g, p), a in counts.items() if " " in p and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        inside = any(g == lang and len(w) > len(words) and 100 * b >= 80 * a and any(w[i:i + len(words)] == words for i in range(len(w)))
                     for (g, w), b in candidates.items())
        if not inside:
            cuts = [(2_000_000 * a // (counts[lang, " ".join(words[:k])] + counts[lang, " ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])], totals[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, rank, *o[1:]) for rank, o in enumerate(best, 1)]
    return sorted(ranked)


def corpus(seed, many, vocabulary=25):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(vocabulary)] + ["é", "ñ-x", "漢"]
    fixed = ["new york city hall", "San Francisco", "at the end of", "\x00odd\x85 word"]
    rows = []
    for _ in range(many):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!\x0b", "\r", " ; "]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" .\n, ", "de")]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", "clash", 0) for i, (t, g) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, size string, many int")


def result(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("seed, least, share, bits", [(1, 5, 0.3, 1 << 20), (2, 3, 0.05, 1 << 16), (3, 8, 1.0, 1 << 18)])
def test_equals_brute_force(spark, seed, least, share, bits):
    rows = corpus(seed, 200)
    got = collocations.collocations(frame_of(spark, rows).repartition(3), top=40, least=least, share=share, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result(got) == brute(rows, least, 40)


def names_of(pairs, seed=collocations.SEED):
    """Names of (lang, word)."""
    digests = lambda texts: collocations.digests([t.encode() for t in texts], seed)[0]
    return collocations.named(digests([w for _, w in pairs]), digests([g for g, _ in pairs]))


def spelt(found, seed, rows):
    """Phrases by their words, of names."""
    pairs = sorted({k for k in with_totals(brute_counts(rows)) if " " not in k[1]})
    word = dict(zip(names_of(pairs, seed).view(np.int64).tolist(), pairs))
    assert all(word[r.lang][1] == "" and word[r.lang][0] == word[r.w1][0] for r in found.collect())
    return {(word[r.w1][0], " ".join(word[w][1] for w in (r.w1, r.w2, r.w3, r.w4) if w)): r.many for r in found.collect()}


def with_totals(counts):
    totals = Counter()
    for (lang, phrase), c in counts.items():
        totals[lang, ""] += c * (" " not in phrase)
    return counts + totals


def test_border_failures_are_closed(spark, monkeypatch):
    rows, taken = corpus(4, 150), []
    real = collocations._missing
    monkeypatch.setattr(collocations, "_missing", lambda *a: taken.append(real(*a)) or taken[-1])
    docs = frame_of(spark, rows)
    monkeypatch.setattr(type(docs), "sample", lambda self, share, seed: self.limit(0))  # proposes nothing
    found = spelt(*collocations.frequent_phrases(docs, least=4, batch_bytes=4 << 10), rows)
    want = {k: c for k, c in with_totals(brute_counts(rows)).items() if c >= 4}
    assert found == want and taken[0].count() == sum(" " not in p for _, p in want)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = corpus(5, 100, vocabulary=60)
    monkeypatch.setattr(collocations.Filter, "holds", lambda self, names: np.ones(len(names), bool))
    assert result(collocations.collocations(frame_of(spark, rows), least=3)) == brute(rows, 3, 2000)


def test_equal_names_are_mined_again(spark, monkeypatch):
    rows, seeds, real = corpus(7, 60), [], collocations._exact

    def colliding(texts, now, before, maybe, seed):
        seeds.append(seed)
        found = real(texts, now, before, maybe, seed)
        return found if len(seeds) > 1 else found.unionByName(found.filter("w2 = 0").limit(1).selectExpr("lang", "w1", "w2", "w3 + 1 AS w3", "w4", "1L AS many"))
    monkeypatch.setattr(collocations, "_exact", colliding)
    found, seed = collocations.frequent_phrases(frame_of(spark, rows), least=4)
    assert seeds == [collocations.SEED, collocations.SEED + 1] and seed == seeds[1]
    assert spelt(found, seed, rows) == {k: c for k, c in with_totals(brute_counts(rows)).items() if c >= 4}


def test_equal_phrase_names_only_raise_bounds(spark, monkeypatch):
    rows = corpus(8, 80)
    want = {k: c for k, c in with_totals(brute_counts(rows)).items() if c >= 5}
    everything = collocations.Filter(64, np.full(1, ~np.uint64(0)))
    monkeypatch.setattr(collocations, "_filter_of", lambda names, bits: everything._replace(words=np.resize(everything.words, bits >> 6), bits=bits))
    assert spelt(*collocations.frequent_phrases(frame_of(spark, rows), least=5), rows) == want


def filter_of(names, bits=1 << 18):
    now = collocations._nothing(bits)
    place = collocations.Filter.places(np.array(names, np.uint64), bits).ravel()
    np.bitwise_or.at(now.words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    return now


def test_passes_count_each_phrase_once():
    rows = corpus(6, 60)
    texts, langs = [(t or "").encode() for t, _ in rows], [g or "und" for _, g in rows]
    want, name = with_totals(brute_counts(rows)), {}
    single = [k for k in want if " " not in k[1]]
    word = dict(zip(names_of(single), single))

    def phrases(now, before):
        for names, columns, many, known, _ in collocations.counted(texts, langs, now, before):
            for n, *parts, count, old in zip(names, *columns, many, known):
                key = word[parts[0]][0], " ".join(word[x][1] for x in parts)
                name[key] = n
                yield key, count, old
    everything = collocations.Filter(64, np.full(1, ~np.uint64(0)))
    assert {k: c for k, c, _ in phrases(everything, None)} == want
    assert len(set(name.values())) == len(name)
    seen, before = Counter(), None
    for threshold in (10, 4, 2, 1):
        now = filter_of([name[k] for k, c in want.items() if c >= threshold])
        fresh = [(k, c) for k, c, old in phrases(now, before) if not old]
        assert not set(seen) & {k for k, _ in fresh} and len(fresh) == len(dict(fresh))
        seen.update(dict(fresh))
        before = now
    assert seen == want


def test_large_counts_are_exact(spark, monkeypatch):
    big = 4 * 10 ** 18
    lang, a, b = names_of([("en", ""), ("en", "a"), ("en", "b")]).view(np.int64).tolist()
    rows = [(lang, lang, 0, 0, 0, big), (lang, a, 0, 0, 0, big), (lang, b, 0, 0, 0, big - 1), (lang, a, b, 0, 0, big - 7)]
    found = spark.createDataFrame(rows, "lang long, w1 long, w2 long, w3 long, w4 long, many long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: (found, collocations.SEED))
    row, = collocations.collocations(frame_of(spark, [("a b", "en")])).collect()
    assert row.score == 2_000_000 * (big - 7) // (2 * big - 1) and tuple(row)[:7] == ("en", 1, "a b", big - 7, big, big - 1, big)


def test_odd_rows_and_empty_tables(spark, odd):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert result(collocations.collocations(odd, least=2)) == brute(rows, 2, 2000)
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd.filter("text is null")).count() == 0
