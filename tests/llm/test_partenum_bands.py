"""Linked sets share a signature, however many size bands lie between them."""

import numpy as np
import pytest

from tillstream.llm import partenum


@pytest.mark.parametrize("percent", [40, 50, 60, 70, 79, 85])
def test_subsets_of_the_least_linked_size_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for size in (*range(5, 40), 60, 100, 101, 250, 777):
        whole = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        least = -(-len(whole) * percent // 100)
        part = np.sort(rng.choice(whole, least, replace=False))
        assert np.intersect1d(partenum.signatures(part, percent), partenum.signatures(whole, percent)).size or least == len(whole), size
