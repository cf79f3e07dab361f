"""Phrase collocations by Toivonen mining: a sample proposes, full passes count exactly, failures expand.

Phrases are runs of 2 to `LONGEST` words inside a piece of text, counted per lang. A phrase is as frequent as its
parts at most, so mining goes by levels:

1. a sample of the rows (`share`), mined level by level for phrases that come `share * least * SLACK` times in it,
   gives the phrases that are probably frequent, S;
2. a full pass counts every phrase whose two longest parts (without its last, without its first word) are in S: these
   are S and its negative border. All single words are counted. Phrases go by a 64-bit name here, so the sums
   bound their counts from above; what reaches `least` may be frequent;
3. one more pass counts the phrases that may be frequent exactly, as sequences of words. A phrase that may be frequent
   but is missing in S is a failure of the border: S takes it up, and the same pass counts, exactly, all that this adds.
   There a phrase that is counted for the first time may be a part too, so what it leads to is counted as
   well, and the mining is closed: by induction on its length every frequent phrase has been counted.

S travels to the tasks as a Bloom filter of `FILTER_BITS` bits at most, whatever its size, and so do the phrases that may
be frequent. A false positive makes tasks count one phrase more, which is exact all the same; beyond its capacity
the filter passes more, and never loses any. S itself and all counts are tables.

Tasks count the phrases of some megabytes of text before anything is shuffled, so a word or passage that every
document has is one row per batch. In exact counts a phrase is the sequence of its words' 64-bit names (a word of a
lang has one name). Words are counted with a second name beside it; should two words share the first one, all is mined
again with another seed, so counts are exact. A lang's words together count as the empty word. Texts are read
once more for the words of the phrases that are returned.

Defined results: a null lang is `und`; null and empty texts have no words; repeated rows count each time; an
empty table gives no phrases; other columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.llm.bloom import Filter, bits_for, filter_of as _filter_of, nothing as _nothing
from tillstream.llm.common import byte_batches, mix64, stored

LONGEST = 4
LEAST = 30
SHARE = 0.0625
SLACK = 0.5
WITHIN = 80  # a phrase goes if a longer one around it has this share of its count, in percent
FILTER_BITS = 1 << 27
SEED = 7
BATCH = 2 << 20  # bytes of text
ROWS = 32_768  # counts handed over at once

# Bytes in lower case; a tab is a space, and what ends a piece a line feed.
_BREAKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
NAMES = [f"w{k}" for k in range(1, LONGEST + 1)]  # a word's name each, 0 beyond the last


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each occurrence its word, its text and its piece, in order."""
    # A carriage return cannot be left in a text, so it marks the next one.
    joined = b" \r ".join(t.translate(_BREAKS).replace(b"\n", b" \n ") for t in texts)
    found = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values.dictionary_encode()
    names, at = found.dictionary.to_pylist(), found.indices.to_numpy()
    mark = np.array([1 if n == b"\n" else 2 if n == b"\r" else 3 if n == b"" else 0 for n in names] or [0], np.int8)
    kind = mark[at]
    real = kind == 0
    number = np.cumsum(mark == 0) - 1
    return ([n for n, m in zip(names, mark) if not m], number[at[real]], np.cumsum(kind == 2, dtype=np.int32)[real],
            np.cumsum((kind == 1) | (kind == 2), dtype=np.int32)[real])


def digests(words: list[bytes], seed: int) -> np.ndarray:
    """Two rows of 64-bit hashes."""
    joined = b"".join(map(xxhash.xxh3_128_digest, words, repeat(seed)))
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2).T


def named(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """64-bit names, not 0, from hashes of words and of their langs."""
    return np.maximum(mix64(words ^ mix64(langs)), np.uint64(1))


def lang_names(codes: list[str], seed: int) -> np.ndarray:
    """The name of a lang is that of its empty word; two rows, as of `digests`."""
    return named(digests([b""], seed), digests([c.encode() for c in codes], seed))


def _sized(names: np.ndarray, size: int) -> np.ndarray:
    """Phrase names: the last two bits tell the number of words."""
    return names & np.uint64(2 ** 64 - 4) | np.uint64(size - 1)


def _langs_of(text: np.ndarray, langs: list[str]) -> tuple[np.ndarray, list[str]]:
    codes = sorted(set(langs))
    number = {c: i for i, c in enumerate(codes)}
    return np.array([number[x] for x in langs], np.int64)[text], codes


def counted(texts: list[bytes], langs: list[str], now: Filter, before: Filter | None, longest: int = LONGEST, seed: int = SEED,
            maybe: Filter | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(names, columns of word names, counts, whether `before` admits them, lang names) of the phrases that `now` admits.

    A phrase is admitted if its two longest parts are admitted and in the filter. Words are always admitted, by `before`
    too, but for none: then nothing has been counted before. With `maybe`, phrases that `before` admits are left out if
    it does not hold them, those that only `now` admits may be parts though no filter holds them, and single words
    have a second name in the third column.
    """
    words, at, text, piece = words_of(texts)
    if not len(at):
        return
    lang_of, codes = _langs_of(text, langs)
    del text
    # `unit` is the number of each occurrence's phrase, -1 if it is not counted.
    kept, unit, many = np.unique(lang_of * len(words) + at, return_inverse=True, return_counts=True)
    lang, word = kept // len(words), kept % len(words)
    hashes, tongue = digests(words, seed), digests([c.encode() for c in codes], seed)
    word_at, (one, other) = unit, named(hashes[:, word], tongue[:, lang])
    del at, lang_of, words, hashes
    tongue = lang_names(codes, seed)
    names, known = _sized(one, 1), np.full(len(kept), before is not None)
    used, start = np.unique(lang, return_index=True)
    single = lambda a, b: [a, np.zeros(len(a), np.uint64), b] if maybe else [a]
    yield _sized(tongue[0, used], 1), single(*tongue[:, used]), np.add.reduceat(many, start), known[:len(used)], tongue[0, used]
    columns = single(one, other)
    for size in range(1, longest + 1):
        yield names, columns, many, known, tongue[0, lang]
        if size == longest or len(unit) < 2:
            return
        usable = now.holds(names)
        if maybe:
            usable = usable & maybe.holds(names) | ~known
        usable = np.append(usable, False)[unit]  # -1 finds the appended one
        place = np.flatnonzero(usable[:-1] & usable[1:] & (piece[size:] == piece[:len(piece) - size]))
        was = known & before.holds(names) if before else np.zeros(len(names), bool)
        joined = lambda left, last: _sized(mix64(names[left] * np.uint64(0x9E3779B97F4A7C15) + last), size + 1)
        if maybe and len(place):
            left, right = unit[place], unit[place + 1]
            place = place[~(was[left] & was[right]) | maybe.holds(joined(left, one[word_at[place + size]]))]
        if not len(place):
            return
        kept, number, many = np.unique(unit[place] * len(names) + unit[place + 1], return_inverse=True, return_counts=True)
        left, right = kept // len(names), kept % len(names)
        somewhere = np.empty(len(kept), np.int64)
        somewhere[number] = place
        last = one[word_at[somewhere + size]]
        names, columns, known, lang = joined(left, last), [c[left] for c in columns[:size]] + [last], was[left] & was[right], lang[left]
        unit = np.full(len(unit) - 1, -1)
        unit[place] = number


def _texts(batch: pa.RecordBatch) -> tuple[list[bytes], list[str]]:
    """Texts and langs; what Arrow holds of former batches goes back first."""
    pa.default_memory_pool().release_unused()
    return [t or b"" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[low:low + ROWS].view(np.int64)) for c in columns], names=names)


def _bounds(texts: DataFrame, now: Filter, before: Filter | None, longest: int, seed: int, least: int) -> DataFrame:
    """(name, many) of what `now` admits and `before` did not, sums of `least` or more: no phrase comes more often than that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, _, many, known, _ in counted(*_texts(batch), now, before, longest, seed):
                yield from _sliced([names[~known], many[~known]], ["name", "many"])
    return texts.mapInArrow(run, "name long, many long").groupBy("name").agg(F.sum("many").alias("many")).filter(F.col("many") >= least)


def _exact(texts: DataFrame, now: Filter, before: Filter, maybe: Filter, seed: int) -> DataFrame:
    """lang, w1..w4, many: exact counts of the phrases that `maybe` holds and of those that only `now` admits.

    A single word has its second name as w3.
    """
    columns = ["lang", *NAMES, "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, found, many, known, lang in counted(*_texts(batch), now, before, LONGEST, seed, maybe):
                wanted = maybe.holds(names) | ~known
                empty = np.zeros(int(wanted.sum()), np.int64)
                yield from _sliced([lang[wanted]] + [c[wanted] for c in found] + [empty] * (LONGEST - len(found)) + [many[wanted]], columns)
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in columns)).groupBy("lang", *NAMES).agg(F.sum("many").alias("many"))


def _missing(names: DataFrame, held: Filter) -> DataFrame:
    """Names of phrases shorter than the longest that the filter does not hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~held.holds(batch.column("name").to_numpy().view(np.uint64))))
    return names.filter(F.col("name").bitwiseAND(F.lit(3)) < LONGEST - 1).select("name").mapInArrow(run, "name long")


def _levels(texts: DataFrame, least: int, bits: int, seed: int) -> Filter:
    """Filter, of `bits` at most, of the phrases shorter than the longest that come `least` times; one pass a level."""
    often = stored(_bounds(texts, _nothing(64), None, 1, seed, least))
    size = bits_for(often.count(), bits)
    before, now = _nothing(size), _filter_of(often, size)
    for length in range(2, LONGEST):
        often = _bounds(texts, now, before, length, seed, least)
        before, now = now, Filter(size, now.words | _filter_of(often, size).words)
    return now


def _spelt(texts: DataFrame, names: DataFrame, bits: int, seed: int) -> DataFrame:
    """(name, lang, word) of the words behind `name`."""
    held = _filter_of(names, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = _texts(batch)
            words, at, text, _ = words_of(texts)
            if not len(at):
                continue
            lang_of, codes = _langs_of(text, langs)
            kept = np.unique(lang_of * len(words) + at)
            lang, word = kept // len(words), kept % len(words)
            found = named(digests(words, seed)[0, word], digests([c.encode() for c in codes], seed)[0, lang])
            wanted = np.flatnonzero(held.holds(found))
            rows = [(codes[lang[i]], words[word[i]]) for i in wanted] + [(c, b"") for c in codes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found[wanted], lang_names(codes, seed)[0]).view(np.int64)), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())], names=["name", "lang", "word"])
    return texts.mapInArrow(run, "name long, lang string, word string").distinct().join(names, "name", "left_semi")


def _texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, share: float = SHARE, bits: int = FILTER_BITS,
                     batch_bytes: int = BATCH, seed: int = SEED) -> tuple[DataFrame, int]:
    """(lang, w1..w4, many) of the phrases of 1 to `LONGEST` words that come `least` times, by names, and the seed of these.

    The empty word of a lang, named as the lang is, stands for all its words.
    """
    texts = _texts_of(docs)
    with byte_batches(docs.sparkSession, batch_bytes):
        now = _levels(texts.sample(share, SEED), max(2, int(share * least * SLACK)), bits, seed)
        possible = stored(_bounds(texts, now, None, LONGEST, seed, least))
        wider = Filter(now.bits, now.words | _filter_of(_missing(possible, now), now.bits).words)
        single = F.col(NAMES[1]) == 0
        found = stored(_exact(texts, wider, now, _filter_of(possible, now.bits), seed).filter((F.col("many") >= least) | single))
    if not found.filter(single).groupBy(NAMES[0]).count().filter("count > 1").isEmpty():
        return frequent_phrases(docs, least, share, bits, batch_bytes, seed + 1)
    return found.filter(F.col("many") >= least).withColumn(NAMES[2], F.when(single, 0).otherwise(F.col(NAMES[2]))), seed


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, share: float = SHARE, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each lang whose words belong together most.

    A phrase of count a is cut after its first k words, which come l times, the rest r times; the cut of the lowest
    floor(2000000 a / (l + r)) counts, then the smallest k. A phrase inside a longer one that comes nearly as often goes.
    """
    found, seed = frequent_phrases(docs, least, share, bits)
    counts = found.select("lang", F.filter(F.array(*NAMES), lambda w: w != 0).alias("words"), "many").withColumn("size", F.size("words"))
    longer = counts.filter("size > 1")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.slice("words", s, m))))
    around = longer.filter("size > 2").select("many", F.explode(inner).alias("words")).groupBy("words").agg(F.max("many").alias("around"))
    kept = longer.join(around, "words", "left").filter(
        F.col("around").isNull() | (F.lit(100) * _wide("around") < F.lit(WITHIN) * _wide("many")))
    cuts = kept.select("lang", "words", F.col("many").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("head"),
                       F.slice("words", F.col("k") + 1, F.col("size")).alias("tail"))
    counted_as = lambda name, count: counts.select(F.col("words").alias(name), F.col("many").alias(count))
    cuts = cuts.join(counted_as("head", "l"), "head").join(counted_as("tail", "r"), "tail")
    cuts = cuts.withColumn("score", F.expr("2000000 * cast(a AS decimal(31,0)) div (cast(l AS decimal(20,0)) + r)"))
    worst = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "words", "cut.*")
    # Ties at the end stay until the words are known.
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = stored(worst.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place", "k"))
    wanted = stored(best.select(F.explode(F.concat(F.array("lang"), "words")).alias("name")).distinct())
    with byte_batches(docs.sparkSession, BATCH):
        words = stored(_spelt(_texts_of(docs), wanted, bits_for(wanted.count(), bits), seed))
    spelt = best.select("words", F.posexplode("words").alias("at", "name")).join(words, "name").groupBy("words").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = counts.filter("words[0] = lang").select("lang", F.col("many").alias("n")).join(
        words.filter("word = ''").select(F.col("name").alias("lang"), F.col("lang").alias("code")), "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    last = best.join(spelt, "words").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return last.join(totals, "lang").select(F.col("code").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
