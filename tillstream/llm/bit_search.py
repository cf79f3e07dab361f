"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring.

`build_index` writes one signature per document. A signature holds every term, and every term again for each
level of `LEVELS` that its count reaches, as `HASHES` bits. Documents of one batch whose signatures have the
same width (a power of two, `BITS` to 2 * `BITS` bits per entry) form a block, stored by slice: row s is a bitmap of
the documents that have bit s. Beside it lie the documents' lengths and the batch's terms with the number of
documents that hold them, so document frequencies are exact.

`search` reads the slices of the query terms only. The AND of a term's slices marks the documents that may hold it
(none that does is missed), the levels bound its count from above, and with the document's length that bounds its
share of the score. The bounds of all terms of an item, weighted, sum up to a bound of the whole score:

1. per item the `SEEDS` documents with the highest bounds are scored exactly; the k-th best score is a floor;
2. every document whose bound reaches the floor is scored exactly from its whole text, no other one can be
   among the k best.

Queries are read in blocks of about `BLOCK_TERMS` terms, each block's terms travel to the tasks; documents to be
rescored are joined by id, through a broadcast only if a count shows the list to be short.

Scores are integers: a term of weight w = floor(1000 * ln((2N + 2) / (2 df + 1))) gives
w * ((1000000000 * tf) div (1000 * tf + 12 * m)), m = 75 + (25 * n * N) div L, for each time the item repeats it.

Defined results: null, empty and wordless texts have no terms and are never returned, nor counted in N; an item
without terms (null, empty) has no rows; repeated rows of documents are documents of their own, repeated items items of
their own with the same item_id; equal scores rank by doc_id, null ids first; with an empty table on either side there
are no rows; other columns of any name are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillstream.llm.common import byte_batches, ensure_checkpoint_dir, mix64, stored, text_or_empty

# Fixed value: a term is a run of ASCII letters and digits and of characters beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEVELS = (1, 2, 4, 8, 16)
HASHES = 4
BITS = 8
SEEDS = 64
BLOCK_TERMS = 20_000
SHORT_LIST = 500_000  # (document, item) pairs that may be broadcast
CELLS = 1 << 21  # numbers in a working matrix

# Bytes of terms in lower case, all others as spaces; a line feed ends a document.
_TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def term_ids(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct terms, and for each occurrence its term and its document, in order."""
    joined = b" \n ".join(t.translate(_TERMS) for t in texts)
    found = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values.dictionary_encode()
    names, at = found.dictionary.to_pylist(), found.indices.to_numpy()
    special = np.array([n == b"" or n == b"\n" for n in names] or [False])
    row = np.cumsum(at == names.index(b"\n")) if b"\n" in names else np.zeros(len(at), np.int64)
    real = ~special[at]
    number = np.cumsum(~special) - 1
    return [n for n in names if n not in (b"", b"\n")], number[at[real]], row[real]


def hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def slots(terms: np.ndarray, level: int, width: int) -> np.ndarray:
    """Slices of term hashes at a level: one row per hash function."""
    first = mix64(terms ^ np.uint64(0x9E3779B97F4A7C15 >> level))
    step = mix64(first) | np.uint64(1)
    return (first + np.arange(HASHES, dtype=np.uint64)[:, None] * step) >> np.uint64(64 - width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a batch, widest last; the first one carries the terms of the whole batch."""
    for batch in batches:
        terms, at, row = term_ids([t or b"" for t in batch.column("text").to_pylist()])
        sizes = np.bincount(row, minlength=batch.num_rows)
        if not len(at):
            continue
        keys, tf = np.unique(row * len(terms) + at, return_counts=True)
        doc, term, code = keys // len(terms), keys % len(terms), hashes(terms)
        reached = [tf >= level for level in LEVELS]
        entries = sum(np.bincount(doc[r], minlength=batch.num_rows) for r in reached)
        widths = np.ceil(np.log2(np.maximum(entries, 4) * BITS)).astype(int)
        held = np.bincount(term, minlength=len(terms))
        for n, width in enumerate(np.unique(widths[sizes > 0])):
            members = np.flatnonzero((widths == width) & (sizes > 0))
            column = np.full(batch.num_rows, -1)
            column[members] = np.arange(len(members))
            bits = np.zeros((1 << int(width), len(members)), bool)
            inside = column[doc] >= 0
            for level, r in enumerate(reached):
                use = np.flatnonzero(r & inside)
                bits[slots(code[term[use]], level, int(width)), column[doc[use]]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(width)], pa.int32()), pa.array([batch.column("doc_id").take(pa.array(members)).to_pylist()], pa.list_(batch.schema.field("doc_id").type)),
                 pa.array([sizes[members].tolist()], pa.list_(pa.int64())), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
                 pa.array([terms if n == 0 else []], pa.list_(pa.binary())), pa.array([held.tolist() if n == 0 else []], pa.list_(pa.int32()))],
                names=["width", "doc_ids", "sizes", "slices", "terms", "held"])


def build_index(docs: DataFrame, folder: str, batch_bytes: int = 4 << 20) -> None:
    """Write the signatures of all rows of `docs` to `folder`."""
    kind = dict(docs.dtypes)["doc_id"]
    with byte_batches(docs.sparkSession, batch_bytes):
        docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_blocks, (
            f"width int, doc_ids array<{kind}>, sizes array<long>, slices binary, terms array<binary>, held array<int>")).write.parquet(folder)


@dataclass
class Queries:
    """A block of items: distinct terms with weights, and the items' terms as offsets into them."""

    terms: list[bytes]
    weights: np.ndarray
    starts: np.ndarray  # of each item in `at`
    at: np.ndarray
    times: np.ndarray
    docs: int  # N
    words: int  # L

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return 75 + (25 * sizes * self.docs) // self.words

    def total(self, parts: np.ndarray) -> np.ndarray:
        """Sums over each item's terms of (terms x documents) scores."""
        return np.add.reduceat(parts[self.at] * self.times[:, None], self.starts, axis=0)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def upper_bounds(queries: Queries, width: int, sizes: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, items x documents) bounds of a block, some documents at a time."""
    stride = -(-len(sizes) // 8)
    table = np.frombuffer(slices, np.uint8).reshape(1 << width, stride)
    code = hashes(queries.terms)
    step = max(1, CELLS // (8 * max(len(code), len(queries.at))))  # bytes of a slice
    m = queries.lengths(sizes)
    # Most occurrences that fit to the levels reached: none, 1, 3, 7, 15, all words.
    most = np.array([0] + [high - 1 for high in LEVELS[1:]] + [np.iinfo(np.int32).max])[:, None]
    best = saturated(np.minimum(most, sizes), m)
    for low in range(0, stride, step):
        part = table[:, low:low + step]
        first, last = 8 * low, min(8 * (low + part.shape[1]), len(sizes))
        level = np.zeros((len(code), last - first), np.int8)
        alive = None
        for n in range(len(LEVELS)):
            found = np.bitwise_and.reduce(part[slots(code, n, width)], axis=0)
            alive = found if alive is None else alive & found
            if not alive.any():
                break
            level += np.unpackbits(alive, axis=1, count=last - first).view(np.int8)
        share = best[level, np.arange(first, last)]
        yield first, queries.total(share * queries.weights[:, None])


def _seeds(queries: Queries, seeds: int, kind: pa.DataType):
    """Per task and item the documents of the highest bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(queries.starts)
        floor = np.zeros(many, np.int64)  # bounds of a task's seeds so far; at most these are of no use
        pool: list[list[tuple[int, object]]] = [[] for _ in range(many)]
        for batch in batches:
            for width, ids, sizes, slices in zip(*(batch.column(c).to_pylist() for c in ("width", "doc_ids", "sizes", "slices"))):
                for first, bound in upper_bounds(queries, width, np.array(sizes), slices):
                    for item in np.flatnonzero((bound > floor[:, None]).any(axis=1)):
                        row = bound[item]
                        above = np.flatnonzero(row > floor[item])
                        if len(above) > seeds:
                            above = above[np.argpartition(-row[above], seeds - 1)[:seeds]]
                        held = sorted(pool[item] + [(int(row[d]), ids[first + d]) for d in above], key=lambda x: -x[0])[:seeds]
                        pool[item] = held
                        floor[item] = held[-1][0] if len(held) == seeds else 0
        rows = [(item, bound, doc) for item, held in enumerate(pool) for bound, doc in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], kind)], names=["item", "bound", "doc_id"])
    return run


def _contenders(queries: Queries, floors: np.ndarray, kind: pa.DataType):
    """Per document the items that its bounds do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, sizes, slices in zip(*(batch.column(c).to_pylist() for c in ("width", "doc_ids", "sizes", "slices"))):
                for first, bound in upper_bounds(queries, width, np.array(sizes), slices):
                    doc, item = np.nonzero((bound >= floors[:, None]).T)
                    where = np.flatnonzero(np.diff(doc, prepend=-1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[first + d] for d in doc[where]], kind),
                         pa.ListArray.from_arrays(pa.array(np.append(where, len(item)), pa.int32()), pa.array(item, pa.int32()))], names=["doc_id", "items"])
    return run


def _exact(queries: Queries, floors: np.ndarray):
    """Scores of the listed items from whole texts; those below an item's floor are left out."""
    number = {t: i for i, t in enumerate(queries.terms)}
    ends = np.append(queries.starts[1:], len(queries.at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, at, row = term_ids([t or b"" for t in batch.column("text").to_pylist()])
            known = np.array([number.get(t, -1) for t in terms] or [-1])
            sizes = np.bincount(row, minlength=batch.num_rows)
            used = known[at] if len(at) else at
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[tuple[int, int, int]] = []
            for d, items in enumerate(batch.column("items").to_pylist()):
                mine = used[edges[d]:edges[d + 1]]
                tf = np.bincount(mine[mine >= 0], minlength=len(queries.terms))
                share = queries.weights * saturated(tf, queries.lengths(sizes[d:d + 1]))
                for item in items:
                    part = slice(queries.starts[item], ends[item])
                    score = int((share[queries.at[part]] * queries.times[part]).sum())
                    if score >= floors[item]:
                        out.append((item, d, score))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), batch.column("doc_id").take(pa.array([o[1] for o in out], pa.int64())),
                 pa.array([o[2] for o in out], pa.int64())], names=["item", "doc_id", "score"])
    return run


def _read_items(items: DataFrame) -> DataFrame:
    lowered = F.translate(text_or_empty(), UPPER, LOWER)
    return items.select("item_id", F.regexp_extract_all(lowered, F.lit(TERM), 0).alias("terms")).filter(F.size("terms") > 0)


def _counted(index: DataFrame, terms: list[bytes]) -> Counter:
    """Documents that hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), wanted)
            real = at.is_valid()
            np.add.at(total, at.filter(real).to_numpy(), batch.column("held").flatten().filter(real).to_numpy())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["term", "held"])
    sums = index.select("terms", "held").mapInArrow(run, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
    return Counter({terms[r["term"]]: r["held"] for r in sums.collect()})


def _prepared(index: DataFrame, rows: list, docs: int, words: int) -> Queries:
    terms = sorted({t.encode() for r in rows for t in r["terms"]})
    held, number = _counted(index, terms), {t: i for i, t in enumerate(terms)}
    weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * held[t] + 1))) for t in terms]
    counts = [Counter(number[t.encode()] for t in r["terms"]) for r in rows]
    starts = np.cumsum([0] + [len(c) for c in counts[:-1]])
    return Queries(terms, np.array(weights, np.int64), starts, np.array([t for c in counts for t in c]),
                   np.array([n for c in counts for n in c.values()], np.int64), docs, words)


def _rescored(docs: DataFrame, listed: DataFrame, queries: Queries, floors: np.ndarray) -> DataFrame:
    """Exact scores of the listed (doc_id, items)."""
    pairs = listed.agg(F.sum(F.size("items"))).first()[0] or 0
    side = (F.broadcast(listed) if pairs <= SHORT_LIST else listed).withColumnRenamed("doc_id", "_id")
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    joined = texts.join(side, texts["doc_id"].eqNullSafe(side["_id"])).select("doc_id", "text", "items")
    return joined.mapInArrow(_exact(queries, floors), f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, index: DataFrame, k: int = 20, seeds: int = SEEDS,
           block_terms: int = BLOCK_TERMS, batch_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of `docs` with a score above 0 for each row of `items`.

    `index` is what `build_index` wrote of the same `docs`.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {kind}, score long"
    size = index.select(F.size("doc_ids").alias("docs"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    total = size.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    wanted = stored(_read_items(items))
    asked = wanted.agg(F.sum(F.size("terms"))).first()[0]
    if not asked or not total["docs"]:
        return spark.createDataFrame([], schema)
    blocks = -(-asked // block_terms)
    found = None
    with byte_batches(spark, batch_bytes):
        for block in range(blocks):
            rows = wanted.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
            if rows:
                best = _search_block(docs, index, _prepared(index, rows, total["docs"], total["words"]), k, max(seeds, k))
                names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {dict(items.dtypes)['item_id']}")
                ranked = best.join(names, "item").selectExpr("item_id", "rank", "doc_id", "score")
                found = ranked if found is None else found.unionByName(ranked)
    return found


def _best(scored: DataFrame, k: int, *order) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, index: DataFrame, queries: Queries, k: int, seeds: int) -> DataFrame:
    kind, arrow = dict(docs.dtypes)["doc_id"], index.select("doc_ids").limit(0).toArrow().schema.field(0).type.value_type
    slices = index.select("width", "doc_ids", "sizes", "slices")
    top = _best(slices.mapInArrow(_seeds(queries, seeds, arrow), f"item int, bound long, doc_id {kind}"), seeds, F.desc("bound"))
    listed = stored(top.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items")))
    lowest = np.ones(len(queries.starts), np.int64)
    ranked = _best(_rescored(docs, listed, queries, lowest), k, F.desc("score"))
    floors = lowest.copy()
    for r in ranked.filter(F.col("rank") == k).select("item", "score").collect():  # one row per item of the block
        floors[r["item"]] = r["score"]
    # Rows that share an id come once more under each of their blocks.
    open_ = stored(slices.mapInArrow(_contenders(queries, floors, arrow), f"doc_id {kind}, items array<int>"))
    once = open_.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return stored(_best(_rescored(docs, stored(once), queries, floors), k, F.desc("score"), "doc_id"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index `docs` below the shared folder and search them for `items`."""
    from uuid import uuid4

    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/signatures-{uuid4().hex}"
    build_index(docs, folder)
    return search(docs, items, read_index(docs.sparkSession, folder), k)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
