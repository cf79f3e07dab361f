import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents([(doc_id, text), ...]) with a source and columns that clash with names inside operators."""
    def make(rows, sources=("a", "b", None)):
        full = [(i, t, "en", sources[n % len(sources)], len(t or "")) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("size", "key", "bucket", "score", "kept", "rid", "p1", "sig", "name", "level", "taken", "part", "ids", "content", "node"):
            df = df.selectExpr("*", f"'clash' as {name}")
        return df
    return make


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): a text of n invented words on a few lines."""
    def make(seed, n):
        rng = random.Random(seed)
        parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "ea", "ti"]
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        return "".join(w + (".\n" if rng.random() < 0.08 else " ") for w in words)
    return make


# Null, empty and blank texts, equal rows, null ids, control and rare characters, one very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two"), (None, None),
       (6, "A  b\r\nC\x0b d\x0c e"), (7, "é ü ñ 漢字 ▁▁ x\x00y \x01"), (8, "w" * 20_000), (9, "long tail " * 9_000)]


@pytest.fixture
def odd(documents):
    return documents(ODD)
