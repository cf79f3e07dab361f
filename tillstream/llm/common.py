"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillstream.session import cut_lineage, ensure_checkpoint_dir

# Fixed value: the white space of every word and text contract, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

__all__ = ["WHITE", "WORD", "WordHashes", "bounded_batches", "broadcast_if_small", "byte_batches", "cut_lineage",
           "ensure_checkpoint_dir", "keep_rows", "mix64", "ngram_hashes", "read", "released", "sorted_unique", "stored", "text_or_empty", "word_hashes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Smaller Arrow batches for text, for lazy frames: `rows` rows, or fewer beyond `size` bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def byte_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about `size` bytes, or one row if that is longer, for the jobs run inside the block.

    The caller's settings are put back at the end, so a lazy frame must be written (`stored`) inside.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000000"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it from there.

    Like a checkpoint, but compressed and by column: for wide rows of which later steps read a part.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Mark a written table of narrow rows (a few numbers each) for broadcast if it has at most `rows` rows.

    A larger one is left to a shuffled join.
    """
    return F.broadcast(df) if df.count() <= rows else df


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to `limit` words."""

    def __init__(self, limit: int = 65_536):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow holds beside them goes back to the system after each and at the end."""
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()
    pool.release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit integers (a bijection), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order; quicker on short arrays than a hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; with fewer words, of the whole sequence; none of no words."""
    if not len(words):
        return words
    size = min(n, len(words))
    top = len(words) - size + 1
    acc = mix64(words[:top] + np.uint64(size))
    for j in range(1, size):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[j:top + j])
    return acc


# Fixed values of `word_hashes`: an odd base, one 64-bit number per byte (A-Z as a-z), and what separates words.
BASE = np.uint64(0x5851F42D4C957F2D)
BYTES = mix64(np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
BLANK = np.isin(np.arange(256), list(WHITE.encode()))
SPAN = 1 << 16  # bytes hashed at a time


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    bases = (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SPAN, b, np.uint64))]) for b in bases)


def word_hashes(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z lowered, and where each text's words start (with the end).

    A hash is a polynomial over the bytes, so all words of an array come from one running sum.
    """
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))
    offsets = offsets - offsets[0]
    blank = BLANK[data]
    edges = np.zeros(size + 1, bool)  # places at which a word cannot go on
    edges[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | edges[1:-1]
    starts = np.flatnonzero(starts)
    ends = ~blank
    ends[:-1] &= blank[1:] | edges[1:-1]
    ends = np.flatnonzero(ends) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    power, inverse = _powers()
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + SPAN, side="right"))
        if to <= at:  # a word longer than a span
            out[at] = xxhash.xxh3_64_intdigest(data[low:int(ends[at])].tobytes().lower())
            at += 1
            continue
        span = int(ends[to - 1]) - low
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(BYTES[data[low:low + span]] * power[:span], out=total[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, offsets)


def keep_rows(docs: DataFrame, keys: DataFrame, key: Iterable[str], copies: str) -> DataFrame:
    """Rows of `docs` whose `key` columns are in `keys`, one row for each key.

    `keys` has the key columns, unique, and `copies`, the number of rows of `docs` with the key. Only
    the repeated ones are made distinct, so that the others are filtered without a further shuffle.
    """
    key = list(key)
    on = [docs[c].eqNullSafe(keys[c]) for c in key]
    single = docs.join(keys.filter(F.col(copies) == 1), on, "left_semi")
    repeated = docs.join(keys.filter(F.col(copies) > 1), on, "left_semi").dropDuplicates(key)
    return single.unionByName(repeated)
