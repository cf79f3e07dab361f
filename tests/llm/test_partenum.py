import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillstream.llm import partenum
from tillstream.llm.common import sorted_unique
from tillstream.llm.components import components


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[j:j + n]) for j in range(max(1, len(words) - n + 1))) if words else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    places = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for e in s for j in places[e])
        for e in s:
            places[e].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((str(d), len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def family(rng, words, copies, edits):
    for _ in range(copies):
        out = list(words)
        for _ in range(rng.randint(0, edits)):
            out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
        yield " ".join(out)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(5)
    texts = [prose(i, 20 + 9 * i) for i in range(25)]
    for i in range(8):
        texts += family(rng, prose(i, 20 + 9 * i).split(), 5, 1 + i // 2)
    texts += family(rng, prose(99, 120).split(), 80, 9)  # copies on both sides of the bound, in chains
    passage = prose(77, 60)
    texts += [passage + prose(500 + i, 20) for i in range(40)]  # a shared passage and little else
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(1, 14) for _ in range(6)]
    found = [(i, t) for i, t in enumerate(texts)]
    return found + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (None, "a b c d e f g"), (905, "a b c d e f g")]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(documents, rows, n, percent):
    got = partenum.jaccard_components(documents(rows), n, percent).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, percent)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 100, 147, 300, 900, 4000]:
        for _ in range(12):
            a = sorted_unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
            out = int(rng.integers(0, max(1, (100 - percent) * size // 100) + 1))
            new = rng.integers(0, 2 ** 64, int(rng.integers(0, max(1, (100 - percent) * size // 100) + 1)), dtype=np.uint64)
            b = sorted_unique(np.concatenate([rng.permutation(a)[out:], new]))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)))


def test_components_of_paths_and_hubs(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"x{i}") for i in range(50)] + [("s", "s")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[f"p{i:03}"] for i in range(61)}) == 1
    assert len({got["hub"], *[got[f"x{i}"] for i in range(50)]}) == 1 and got["hub"] != got["p000"]


def test_keep_one_of_each_and_empty_table(documents, odd):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y"), (3, "x y"), (None, "x y"), (4, None)]
    kept = partenum.keep_one_of_each(documents(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert kept.columns == odd.columns
    assert partenum.jaccard_components(odd.limit(0)).count() == 0
    assert partenum.jaccard_components(odd).count() == odd.count()
