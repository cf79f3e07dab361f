"""Token ids in wavelet matrices, one per shard file.

Documents are encoded by a public tokenizer, an end id follows each, and runs of documents in ascending
order of their ids form shards. A shard's ids are stored as bit planes: the plane of the highest bit in
text order, then each further bit after a stable sort by the one before. With the number of ones before
each block of `RANK_BITS` bits a plane answers rank and select, and from these come access to any token,
counts of a token up to a place, and the place of its n-th occurrence, without unpacking the file.

Files are written by Spark as zstd-compressed Parquet, a row per shard: the range partition it comes from, its
number there, the ids of its documents, the number of tokens and the matrix as bytes (`pack`). They
can lie in any store that Spark writes to, and a lost executor's files are written again.

Order: documents are range-partitioned by id, so no task or file sees them all; offsets come from
summing tokens per partition, then per shard. Rows that share an id are ordered by a hash of the text.

Defined results: null text counts as empty and has its end id only; null ids come first; repeated rows
are documents of their own; a document longer than a shard gets a shard to itself; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillstream.llm.common import bounded_batches, broadcast_if_small, cut_lineage, ensure_checkpoint_dir, text_or_empty

MAGIC = b"WVM1"
RANK_BITS = 512
SHARD_TOKENS = 1 << 20
PART_BYTES = 16 << 20
END_ID = 2


class WaveletMatrix:
    """Bit planes of a sequence of unsigned ids, highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for b in range(bits - 1, -1, -1):
            ones = (now >> now.dtype.type(b)) & now.dtype.type(1) != 0
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (RANK_BITS // 8), np.uint8)])
            blocks = np.bitwise_count(packed.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32))
            zeros.append(len(now) - int(ranks[-1][-1]))
            if b:
                now = np.concatenate([now[~ones], now[ones]])
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_BITS
        rest = self.planes[plane][block * RANK_BITS // 8:(i + 7) // 8]
        count = int(self.ranks[plane][block])
        if len(rest):
            count += int(np.bitwise_count(rest[:-1]).sum()) + (int(rest[-1]) & ((1 << ((i - 1) % 8 + 1)) - 1)).bit_count()
        return count

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for p in range(len(self.planes)):
            one = self.planes[p][i // 8] >> (i % 8) & 1
            before = self._ones(p, i)
            i = self.zeros[p] + before if one else i - before
            value = value << 1 | int(one)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the copies of an id among the first i places lie after the last plane."""
        low, high = 0, i
        if value >> len(self.planes):
            return 0, 0
        for p in range(len(self.planes)):
            a, b = self._ones(p, low), self._ones(p, high)
            if value >> (len(self.planes) - 1 - p) & 1:
                low, high = self.zeros[p] + a, self.zeros[p] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Copies of an id among the first i places."""
        low, high = self._range(value, i)
        return high - low

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        if not one:
            ranks = np.minimum(np.arange(len(ranks)) * RANK_BITS, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * RANK_BITS // 8:(block + 1) * RANK_BITS // 8], bitorder="little")
        return block * RANK_BITS + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id, -1 if there are fewer."""
        low, high = self._range(value, self.n)
        if k < 0 or k >= high - low:
            return -1
        i = low + k
        for p in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - p) & 1
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence, by undoing the sorts plane by plane."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            before, b = np.empty_like(now), len(self.planes) - 1 - p
            before[~ones] = now[:self.zeros[p]]
            before[ones] = now[self.zeros[p]:] | now.dtype.type(1 << b)
            now = before
        return now

    def pack(self, lengths: np.ndarray) -> bytes:
        """Bytes of the matrix and of the documents' token counts, with a checksum."""
        head = struct.pack("<4sBQQ", MAGIC, len(self.planes), self.n, len(lengths))
        parts = [struct.pack(f"<{len(self.zeros)}Q", *self.zeros), lengths.astype("<u4").tobytes()]
        for plane, rank in zip(self.planes, self.ranks):
            parts += [plane.tobytes(), rank.astype("<u4").tobytes()]
        body = head + b"".join(parts)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def unpack(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        """The matrix and the documents' token counts."""
        if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged shard")
        magic, bits, n, docs = struct.unpack_from("<4sBQQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sBQQ")
        zeros = list(struct.unpack_from(f"<{bits}Q", data, at))
        at += 8 * bits
        lengths = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        size = -(-n // RANK_BITS) * RANK_BITS // 8
        planes, ranks = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(data, np.uint8, size, at))
            ranks.append(np.frombuffer(data, "<u4", size * 8 // RANK_BITS + 1, at + size))
            at += size + 4 * len(ranks[-1])
        return cls(n, planes, zeros, ranks), lengths


class PieceTokens(dict):
    """Ids of the pieces of plain words as little-endian 32-bit bytes, remembered between words."""

    LIMIT = 500_000

    def __init__(self, model):
        super().__init__()
        self.model = model
        # Byte-level spelling: printable bytes stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        spelled = piece if piece.isascii() else "".join(map(self.spelling.__getitem__, piece.encode()))
        tokens = self.model.tokenize(spelled)
        ids = self[piece] = struct.pack("<I", tokens[0].id) if len(tokens) == 1 else array("I", [t.id for t in tokens]).tobytes()
        return ids


class WordTokens(dict):
    """Ids of words as little-endian 32-bit bytes, remembered between texts.

    White space only separates words for this tokenizer, so a text's ids are those of its words. A
    plain word (Latin letters) is split as the tokenizer splits it, and the ids of the pieces are
    remembered too: capitals and punctuation then cost no new encoding. Other words are encoded whole.
    """

    LIMIT = 500_000
    # Fixed value: the tokenizer's split pattern.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ſ]+")
    MARKS = b".,;:!?)\"]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = PieceTokens(self.tokenizer.model)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        letters = word.rstrip(self.MARKS)
        if letters.isalpha():  # A-Z and a-z, and one run of punctuation at most
            value = self.pieces[letters.lower().decode()]
            if len(letters) < len(word):
                value += self.pieces[word[len(letters):].decode()]
        elif self.PLAIN.fullmatch(text := word.decode("utf-8", "replace")):
            lower = text.lower()
            value = b"".join(map(self.pieces.__getitem__, [lower] if lower.isalpha() else self.PIECE.findall(lower)))
        else:
            value = self._encode(text)
        self[word] = value
        return value

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def _write(path: str, end_id: int, shard_tokens: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(path), struct.pack("<I", end_id)
        ids, docs, size, seq, part = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            blob = WaveletMatrix.build(flat).pack(lengths)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.list_(kind)),
                pa.array([len(flat)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "doc_ids", "n_tokens", "matrix"])
        for batch in batches:
            for number, doc, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                part = number
                found = words.of(text) + end
                if ids and size + len(found) // 4 > shard_tokens:
                    yield shard()
                    ids, docs, size, seq = [], [], 0, seq + 1
                ids.append(found)
                docs.append(doc)
                size += len(found) // 4
        if ids:
            yield shard()
    return run


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                 part_bytes: int = PART_BYTES) -> None:
    """Encode `docs` (doc_id, text) and write the shard files below `folder`."""
    bounded_batches(docs.sparkSession)
    content = docs.select("doc_id", text_or_empty().cast("binary").alias("content"))
    total = content.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("content")]
    placed = content.repartitionByRange(total // part_bytes + 1, *order).sortWithinPartitions(*order)
    kind = dict(content.dtypes)["doc_id"]
    shards = placed.select(F.spark_partition_id().alias("part"), "doc_id", "content").mapInArrow(
        _write(path, end_id, shard_tokens, _arrow_kind(content)), f"part int, seq int, doc_ids array<{kind}>, n_tokens long, matrix binary")
    shards.write.option("compression", "zstd").parquet(folder)


def _arrow_kind(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def _read(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, data in zip(batch.column("first").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("matrix")):
                matrix, lengths = WaveletMatrix.unpack(data.as_py())
                ids = matrix.tokens().astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, kind), pa.array(starts + first), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def offsets(shards: DataFrame) -> DataFrame:
    """part, seq, first: tokens of all shards before each one."""
    sizes = shards.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("many")).select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside")).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("inside")).alias("first"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(folder)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    first = broadcast_if_small(cut_lineage(offsets(shards)))
    placed = shards.join(first, ["part", "seq"]).select("first", "doc_ids", "matrix")
    element = pa.array([], _element_kind(shards)).type
    return placed.mapInArrow(_read(element), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _element_kind(shards: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(shards.schema["doc_ids"].dataType.elementType)


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards of `docs` to the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/wavelet-{uuid4().hex}"
    write_shards(docs, folder, path, end_id)
    return read_shards(spark, folder)
