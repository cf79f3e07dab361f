"""Bloom filters of 64-bit names, built by Spark and sent to tasks; never larger than the caller's bound."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillstream.llm.common import mix64

HASHES = 3


class Filter(NamedTuple):
    """Bloom filter of 64-bit names; `bits` is a power of two."""

    bits: int
    words: np.ndarray

    @staticmethod
    def places(names: np.ndarray, bits: int) -> np.ndarray:
        step = mix64(names) | np.uint64(1)
        return (mix64(step) + np.arange(HASHES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)

    def holds(self, names: np.ndarray) -> np.ndarray:
        at = self.places(names, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def bits_for(many: int, bits: int) -> int:
    """Bits of a filter: 64 for each of `many`, a power of two, `bits` at most."""
    size = 1 << 16
    while size < min(bits, 64 * many):
        size <<= 1
    return size


def nothing(bits: int) -> Filter:
    return Filter(bits, np.zeros(bits >> 6, np.uint64))


def filter_of(names: DataFrame, bits: int) -> Filter:
    """Filter of a column `name`; at most bits / 64 rows of two numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Filter.places(batch.column("name").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                                             names=["place", "bit"])
    found = names.select("name").mapInArrow(run, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(bits, words)
