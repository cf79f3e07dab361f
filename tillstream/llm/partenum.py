"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct n-word shingles. Sets of sizes a and b reach similarity g only if
they differ in at most (1 - g) / (1 + g) * (a + b) elements. Size bands fix that bound k per band. The
domain of shingle hashes is cut into n1 first-level parts of n2 second-level parts each; as the
differences fall into n1 parts, one part has at most k2 of them, and some n2 - k2 of its second-level
parts have none. Each such subset, with the elements that fall into it, is one signature, so linked
sets share one. A subset without elements says nothing and is left out; a small set that has so many
of these that the guarantee might rest on them adds its prefix by hash order, which any two linked
sets of this kind share.

No bucket of a signature is expanded into pairs:

1. Equal sets are one class, named by a 128-bit fingerprint; only different sets are joined.
2. Signatures that two classes share are found by sorting them in arrays. Each task combines its own
   chunk first, so a signature that a third of all sets have is one entry per chunk.
3. Each shared signature names one pivot, its member with the most neighbours; members are
   compared with their pivot only. In a family of near copies this links the bulk at once. Neighbours
   are counted over all chunks: the text that a family comes from is its pivot however the rows are dealt.
4. What is left are signatures whose members beside the pivot are still in several components. These
   go through a prefix filter: shingles ordered by how few of these members have them, the first
   (1 - g) * size + 1 of each, joined on the shingle under the length and position bounds. This is
   exact for the rest and has no cap: linked sets in different components share such a shingle.
5. Candidates are verified on the whole sets, and links are contracted into components.

Texts are shuffled once more for the members of shared signatures, to rebuild their sets.

Defined results: null, empty and blank texts have no shingles and are alone; a text of fewer than n
words is one shingle, the whole sequence; equal texts are in one component; a repeated row is a
document of its own; null ids are ignored in the smallest id unless a component has no other.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillstream.llm.bloom import Filter, bits_for, filter_of
from tillstream.llm.common import (bounded_batches, broadcast_if_small, cut_lineage, mix64, ngram_hashes, released, sorted_unique,
                                   stored, text_or_empty, word_hashes)
from tillstream.llm.components import components

N2, K2 = 2, 1
BAND = 1.25
RARE = 0.02
SEEN = 100_000
CHUNK = 1 << 18  # signatures that a task sorts at a time
BUCKET = 1 << 18  # shingles per bucket, of which well under half become signatures
PARTS = 4  # buckets per receiving task, which takes them one after another
MOST_PARTS = 20_000  # receiving tasks; beyond that a task takes more buckets
FILTER_BITS = 1 << 27  # at most, of the shingles that several open sets have
ELEMENTS = "p1 long, root long, size int, element long"
SALT = np.uint64(0xD6E8FEB86659FD93)


SUBSETS = np.array(list(combinations(range(N2), N2 - K2)))


@lru_cache(maxsize=None)
def bands(top: int = 1 << 40) -> tuple[tuple[int, int], ...]:
    """(lowest, highest) set size of each band, up to a band that holds `top`."""
    out, low = [], 1
    while not out or out[-1][1] < top:
        high = max(low, int(low * BAND))
        out.append((low, high))
        low = high + 1
    return tuple(out)


def _band_of(size: int) -> int:
    return bisect_left(bands(), size, key=lambda b: b[1])


def _tail(mean: float, least: int) -> float:
    """Chance that a Poisson count of this mean is `least` or more."""
    term, below = math.exp(-mean), 0.0
    for i in range(least):
        below += term
        term *= mean / (i + 1)
    return max(0.0, 1.0 - below)


@lru_cache(maxsize=None)
def scheme(band: int, percent: int) -> tuple[int, int, np.ndarray, np.ndarray, np.uint64]:
    """k, n1, the borders of the second-level parts, a number per first-level part and subset, and one more, for pairs
    whose larger set is in `band`.

    n1 is raised above what k asks for until the smallest sets seldom have so many empty subsets that
    the guarantee might rest on them alone.
    """
    low, high = bands()[band]
    k = (100 - percent) * 2 * high // (100 + percent)
    least = n1 = k // (K2 + 1) + 1
    while n1 < 1.4 * least + 2:
        odds = math.exp(-(N2 - K2) * low * percent / 100 / (n1 * N2))
        if _tail(n1 * (1 - (1 - odds) ** math.comb(N2, K2)), n1 - k // (K2 + 1)) < RARE:
            break
        n1 += 1
    borders = np.array([(i << 64) // (n1 * N2) for i in range(1, n1 * N2)], dtype=np.uint64)
    named = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(band << 40)
    return k, n1, borders, mix64(named[:, None] + np.arange(len(SUBSETS), dtype=np.uint64)), named[0] + np.uint64(32)


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set given as sorted unique 64-bit hashes."""
    size = len(elements)
    if not size:
        return np.empty(0, np.uint64)
    out, own = [np.empty(0, np.uint64)], _band_of(size)
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements ^ SALT), dtype=np.uint64)])
    for band in range(own, _band_of(size * 100 // percent) + 1):  # of every larger set that can be linked
        k, n1, borders, named, other = scheme(band, percent)
        if k == 0:  # only equal sets are similar enough
            continue
        cuts = np.concatenate([[0], np.searchsorted(elements, borders), [size]])
        sums = totals[cuts]
        counts = (cuts[1:] - cuts[:-1]).reshape(n1, N2)[:, SUBSETS].sum(2)
        found = mix64(named + (sums[1:] - sums[:-1]).reshape(n1, N2)[:, SUBSETS].sum(2, dtype=np.uint64))
        full = counts > 0
        out.append(found[full])
        # At least n1 - k // (K2 + 1) first-level parts share a subset. Unless some of these must be
        # without an empty one, sets of this kind also share an element of their prefix by hash.
        if n1 - np.count_nonzero(full.all(1)) >= n1 - k // (K2 + 1):
            prefix = size + percent * -size // 100 + 1
            out.append(mix64(elements[:prefix] + mix64(np.array([other]))))
    return np.concatenate(out)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums over each set, a row per set, as signed integers."""
    size = np.array([len(s) for s in sets], np.int64)
    pair = np.zeros((len(sets), 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        flat = np.concatenate(sets)
        starts = (np.cumsum(size) - size)[some]
        pair[some, 0] = np.add.reduceat(mix64(flat), starts)
        pair[some, 1] = np.add.reduceat(mix64(flat + SALT), starts)
    return mix64(pair + size.astype(np.uint64)[:, None]).view(np.int64)


def _sets(texts: pa.BinaryArray, n: int) -> list[np.ndarray]:
    """The distinct shingles of each text, in ascending order."""
    words, at = word_hashes(texts)
    grams = ngram_hashes(words, n) if len(words) >= n else words[:0]
    return [sorted_unique(grams[a:b - n + 1] if b - a >= n else ngram_hashes(words[a:b], n)) for a, b in zip(at.tolist(), at[1:].tolist())]


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sets = _sets(batch.column("content"), n)
            prints = fingerprints(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(prints[:, 0]), pa.array(prints[:, 1])],
                names=["doc_id", "n_shingles", "p1", "p2"])
    return run


def _signature_blocks(n: int, percent: int, buckets: int):
    """Signatures with their class, in one block of arrays per chunk and bucket.

    Within a chunk a signature travels once, with the number of the chunk's classes that have it; the others (with 0)
    are known to share it and go to a bucket of their own class, so that a signature of very many sets
    costs its bucket one entry per chunk.
    """
    def blocks(sigs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(sigs, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], sigs[order][1:] != sigs[order][:-1]]))
        counts = np.zeros(len(sigs), np.int32)
        counts[order[starts]] = np.diff(starts, append=len(sigs))
        bucket = (np.where(counts == 0, mix64(names.view(np.uint64)), sigs) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[by], return_index=True)
        cuts = [*starts.tolist(), len(by)]
        parts = [by[x:y] for x, y in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([
            pa.array(found, pa.int64()), *[pa.array([v[x].tobytes() for x in parts], pa.binary()) for v in (sigs, names, counts)]],
            names=["bucket", "sigs", "names", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, names, many = [], [], 0
        for batch in released(batches):
            sets = _sets(batch.column("content"), n)
            for s, name in zip(sets, fingerprints(sets)[:, 0].tolist()):
                if not len(s):
                    continue
                if name in seen:  # copies within a task give their signatures once
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                found = signatures(s, percent)
                sigs.append(found)
                names.append(np.full(len(found), name, np.int64))
                many += len(found)
                if many >= CHUNK:
                    yield blocks(np.concatenate(sigs), np.concatenate(names))
                    sigs, names, many = [], [], 0
        if many:
            yield blocks(np.concatenate(sigs), np.concatenate(names))
    return run


def _shared_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, p1, many, tells) of the signatures that classes share, bucket by bucket; a partition's rows come sorted by bucket.

    `many` is the number of classes with the signature, 0 where the bucket of another row has counted it; of the
    rows that have it one `tells` it to those.
    """
    bucket, columns = None, [[], [], []]
    for batch in released(batches):
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "names", "counts"))):
            if at != bucket:
                yield from _shared_of(columns)
                bucket, columns = at, [[], [], []]
            for column, value in zip(columns, row):
                column.append(value)
    yield from _shared_of(columns)


def _shared_of(columns: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    sigs, names, counts = (np.frombuffer(b"".join(c), t) for c, t in zip(columns, (np.int64, np.int64, np.int32)))
    if not len(sigs):
        return
    known = counts == 0
    order = np.argsort(sigs[~known], kind="stable")
    s, p, many = sigs[~known][order], names[~known][order], counts[~known][order].astype(np.int64)
    tells = np.zeros(len(s), bool)
    if len(s):
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size, total = np.diff(starts, append=len(s)), np.add.reduceat(many, starts)
        tells[starts] = total > size
        keep = np.repeat((np.minimum.reduceat(p, starts) != np.maximum.reduceat(p, starts)) | (total > size), size)
        s, p, many, tells = s[keep], p[keep], np.repeat(total, size)[keep], tells[keep]
    others = int(known.sum())
    yield pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([s, sigs[known]])), pa.array(np.concatenate([p, names[known]])),
        pa.array(np.concatenate([many, np.zeros(others, np.int64)])), pa.array(np.concatenate([tells, np.zeros(others, bool)]))],
        names=["sig", "p1", "many", "tells"])


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sets = _sets(batch.column("content"), n)
            prints = fingerprints(sets)
            yield pa.RecordBatch.from_arrays([
                pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([(s >> np.uint64(48)).astype(np.uint16).tobytes() for s in sets], pa.binary())],
                names=["p1", "p2", "elements", "short"])
    return run


def _linked(percent: int, kind: type, out: tuple[str, str]):
    """Keep pairs whose sets reach the similarity; shortened elements (`kind`) may keep a few more."""
    def common(x: np.ndarray, y: np.ndarray) -> int:
        if kind is np.uint64:
            return len(np.intersect1d(x, y, assume_unique=True))
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return int((y[at] == x).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            left, right = (batch.column(c).to_pylist() for c in ("a_set", "b_set"))
            keep = []
            for a, b in zip(left, right):
                x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
                both = min(common(x, y), len(y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(list(out)).filter(pa.array(keep, pa.bool_()))
    return run


def _node(p1: Column, p2: Column) -> Column:
    return F.concat(F.lpad(F.hex(p1), 16, "0"), F.lpad(F.hex(p2), 16, "0"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among (a1, b1) pairs of first fingerprints; a and b of the result are class names.

    Sizes are compared first, then the sets with elements shortened to 16 bits, which can only look more
    alike than they are; what is left is compared in full.
    """
    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        out = pairs
        for side in "ab":
            out = out.join(sets.select(F.col("p1").alias(f"{side}1"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}1")
        return out
    sizes = broadcast_if_small(cut_lineage(sets.select("p1", "size").distinct()))
    close = (pairs.join(sizes.select(F.col("p1").alias("a1"), F.col("size").alias("a_size")), "a1")
             .join(sizes.select(F.col("p1").alias("b1"), F.col("size").alias("b_size")), "b1")
             .filter(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")).select("a1", "b1").distinct())
    alike = cut_lineage(sides(close, "short").withColumnsRenamed({"a_short": "a_set", "b_short": "b_set"})
                        .mapInArrow(_linked(percent, np.uint16, ("a1", "b1")), "a1 long, b1 long").distinct())
    needed = broadcast_if_small(cut_lineage(alike.select(F.col("a1").alias("p1")).union(alike.select("b1")).distinct()))
    sets = sets.join(needed, "p1", "left_semi")
    return cut_lineage(sides(alike, "node", "elements").select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_elements").alias("a_set"), F.col("b_elements").alias("b_set"))
        .mapInArrow(_linked(percent, np.uint64, ("a", "b")), "a string, b string"))


def _rest(members: DataFrame, pivots: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a1, b1) in different components among the members of signatures left open.

    A signature is open if its members beside the pivot, which has met them all, are in several components.
    """
    names = sets.select("p1", "node").join(roots, "node", "left").select(
        "p1", F.xxhash64(F.coalesce("root", "node")).alias("root")).distinct()
    names = broadcast_if_small(cut_lineage(names))
    at = members.join(names, "p1")
    others = at.join(pivots, "sig").filter("p1 <> b1")
    still = others.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("sig")
    left = cut_lineage(others.join(still, "sig", "left_semi").select("p1", "root").distinct())
    if left.isEmpty():
        return left.select(F.col("p1").alias("a1"), F.col("p1").alias("b1"))
    members_of = sets.select("p1", "size", "elements").join(broadcast_if_small(left), "p1")
    # An element that no other set has cannot be shared; it only moves the others back in the order. Counts are added up
    # before their exchange; a filter of what several sets have keeps the rest out of the join, which AQE can split.
    many = stored(members_of.mapInArrow(_element_rows(None), ELEMENTS).groupBy("element").agg(F.count("*").alias("many")).filter("many > 1"))
    held = filter_of(many.select(F.col("element").alias("name")), bits_for(many.count() // 4, FILTER_BITS))
    counted = members_of.mapInArrow(_element_rows(held), ELEMENTS).join(many, "element")
    own = counted.groupBy("p1", "root", "size").agg(F.sort_array(F.collect_set(F.struct("many", "element"))).alias("own"))
    alone = F.col("size") - F.size("own")
    length = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100).cast("int") + 1 - alone
    prefix = cut_lineage(own.filter(length > 0).select("p1", "root", "size", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), length)).alias("pos", "e"))
                         .select("p1", "root", "size", (F.col("pos") + F.col("alone")).alias("pos"), F.col("e.element").alias("element")))
    a = prefix.select("element", *[F.col(c).alias(f"a_{c}") for c in ("p1", "root", "size", "pos")])
    b = prefix.select("element", *[F.col(c).alias(f"b_{c}") for c in ("p1", "root", "size", "pos")])
    needed = F.ceil(F.lit(percent) * (F.col("a_size") + F.col("b_size")) / (100 + percent))
    most = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    fits = ((F.col("a_root") < F.col("b_root")) & (most >= needed)
            & (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")))
    return cut_lineage(a.join(b, "element").filter(fits).select(F.col("a_p1").alias("a1"), F.col("b_p1").alias("b1")).distinct())


def _element_rows(held: Filter | None):
    """A row per element of a set, of those that `held` holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sets = [np.frombuffer(x, np.int64) for x in batch.column("elements").to_pylist()]
            for at in range(0, len(sets), 64):
                part = sets[at:at + 64]
                if held:
                    part = [x[held.holds(x.view(np.uint64))] for x in part]
                take = pa.array(np.repeat(np.arange(at, at + len(part)), [len(x) for x in part]))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(take) for c in ("p1", "root", "size")], pa.array(np.concatenate(part))],
                    names=["p1", "root", "size", "element"])
    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    that links reach.
    """
    bounded_batches(docs.sparkSession)
    content = docs.select("doc_id", text_or_empty().cast("binary").alias("content"))
    kind = dict(content.dtypes)["doc_id"]
    rows = cut_lineage(content.mapInArrow(_fingerprints(n), f"doc_id {kind}, n_shingles long, p1 long, p2 long"))
    classes = rows.filter("n_shingles > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("least"))
    links = find_links(content, rows, n, percent)
    roots = components(links)
    named = classes.select("p1", "p2", "least", _node(F.col("p1"), F.col("p2")).alias("node"))
    reached = named.join(roots, "node").select("p1", "p2", "least", "root")
    smallest = reached.groupBy("root").agg(F.min("least").alias("component"))
    joined = reached.join(smallest, "root").select("p1", "p2", "component")
    merged = cut_lineage(classes.join(joined, ["p1", "p2"], "left").select(
        "p1", "p2", F.coalesce("component", "least").alias("component")))
    found = rows.filter("n_shingles > 0").join(merged, ["p1", "p2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def find_links(content: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect every component, between names of classes of equal sets."""
    # Blocks are dealt so that a task of the receiving side sorts some hundred thousand signatures at a time.
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = total // BUCKET + 1
    blocks = content.select("content").mapInArrow(
        _signature_blocks(n, percent, buckets), "bucket long, sigs binary, names binary, counts binary")
    dealt = blocks.repartition(min(buckets // PARTS + 1, MOST_PARTS), "bucket").sortWithinPartitions("bucket")
    members = stored(dealt.mapInArrow(_shared_signatures, "sig long, p1 long, many long, tells boolean"))
    told = broadcast_if_small(stored(members.filter("tells").select("sig", F.col("many").alias("told"))))
    weight = broadcast_if_small(cut_lineage(members.join(told, "sig", "left").groupBy("p1").agg(
        F.sum(F.coalesce("told", "many")).alias("weight"))))
    pivots = stored(members.join(weight, "p1").groupBy("sig").agg(F.max(F.struct("weight", "p1")).alias("best")).select(
        "sig", F.col("best.p1").alias("b1")))
    pairs = cut_lineage(members.join(pivots, "sig").filter("p1 <> b1").select(
        F.least("p1", "b1").alias("a1"), F.greatest("p1", "b1").alias("b1")).distinct())
    sets = stored(_sets_of(content, rows, weight.select("p1"), n))
    first = _verified(pairs, sets, percent)
    roots = components(first)
    rest = _rest(members.select("sig", "p1"), pivots, sets, roots, percent)
    return first.unionByName(_verified(rest, sets, percent))


def _sets_of(content: DataFrame, rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """p1, node, size, elements of the wanted classes, from the text of one document of each.

    A repeated id may give a class twice, which later steps bear.
    """
    ids = broadcast_if_small(cut_lineage(rows.join(wanted, "p1", "left_semi").groupBy("p1", "p2").agg(
        F.min("doc_id").alias("least")).select("least").distinct()))
    texts = content.join(ids, content["doc_id"].eqNullSafe(ids["least"]), "left_semi").select("content")
    return texts.mapInArrow(_set_rows(n), "p1 long, p2 long, elements binary, short binary").select(
        "p1", _node(F.col("p1"), F.col("p2")).alias("node"), (F.octet_length("elements") / 8).cast("int").alias("size"), "elements", "short")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component, that of the smallest id, all columns as they are.

    Rows that share an id are one document here; rows without an id stay.
    """
    kept = jaccard_components(docs, n, percent).filter(F.col("doc_id") == F.col("component_id")).groupBy(
        F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_copies"))
    on = docs["doc_id"] == kept["_kept"]
    single = docs.join(kept.filter("_copies = 1"), on, "left_semi")
    repeated = docs.join(kept.filter("_copies > 1"), on, "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).unionByName(docs.filter("doc_id is null"))
