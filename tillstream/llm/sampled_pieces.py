"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text becomes a lattice: its pieces are the vocabulary of a public model, space is the mark U+2581 and
a leading mark is added, as that library does; a character without a piece is spelled in byte pieces.
The probability of a segmentation is the normalised product of its pieces' weights; a BPE model
only ranks its pieces, so a piece of rank r weighs 1 / (r + 1) ** theta.

The k segmentations come from an A* search on Gumbel-perturbed log probabilities, from the top down.
A region of the lattice has one perturbed value, the largest of its segmentations. The search takes the
region of the largest value, draws a segmentation from it by forward-filtering backward-sampling (its
value is that of the region), and splits the rest of the region at each place where another segmentation
may first turn off; each part gets a Gumbel value cut off at its parent's. So the first k drawn are a
sample without replacement in order, and the value of the best region left, kappa, gives each one's
inclusion score: the chance 1 - exp(-exp(log_prob - kappa)) of being above it.

No piece crosses from one unit (a run of marks with the characters after it, or one line break) into
the next, so the lattice is a chain of unit lattices. Forward sums are made once per distinct unit of an
Arrow batch, for all units at once; draws go step by step for all places of a batch at once. Random
numbers come from a generator per row, seeded by a hash of row key and seed, so runs and
partitionings agree. Memory is bounded by the group (`BATCH` rows, `GROUP_CHARS`), not by the table.

Defined results: null text counts as empty; an empty text has one segmentation, the empty one, with
score 1; a text with fewer than k segmentations returns all of them (kappa is then minus infinity and
each score is 1); repeated rows with equal keys get equal samples; a null key is a key.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tillstream.llm.common import bounded_batches, released

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
LONGEST = 16
SAMPLES = 2
THETA = 1.0
BATCH = 700
GROUP_CHARS = 600_000  # of the texts sampled together, some 100 MB of arrays
TRIES = 50
ROUNDING = 1e-6  # chance below which what is left of a unit counts as nothing
SPELLED = 1 << 21  # ids from here on stand for a character in bytes


class Vocabulary:
    """Pieces of a SentencePiece model as hash tables for whole arrays of substrings."""

    SLOTS = 1 << 18
    FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
    BASE = np.uint64(0xD1342543DE82EF95)

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        self.bytes = [b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in zip(ids, pieces)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in ids:
            if model.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
        rank = np.arange(1, len(plain) + 1, dtype=np.float64)
        weight = rank ** -theta
        self.least = float(weight[-1] / weight.sum())  # of a byte piece
        keys = np.array([self._hash(pieces[i]) for i in plain], dtype=np.uint64)
        self.tables = []
        left = np.arange(len(plain))
        for factor in self.FACTORS:
            table, at = np.full(self.SLOTS, -1, np.int32), ((keys[left] * factor) >> np.uint64(46)).astype(np.int64)
            table[at] = left
            self.tables.append(table)
            left = left[table[at] != left]
        if len(left):
            raise ValueError("the hash tables of pieces are too small")
        # The last entry is "no piece".
        self.keys = np.append(keys, np.uint64(0))
        self.ids = np.append(np.array(plain, np.int32), np.int32(-1))
        self.weights = np.append(weight / weight.sum(), 0.0).astype(np.float32)
        self.log_weight = np.full(len(pieces), np.log(self.least))
        self.log_weight[plain] = np.log(weight / weight.sum())

    def _hash(self, piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * self.BASE + np.uint64(ord(c) + 1)
        return int(h)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and the index of each in `keys`."""
        places, found, todo = [], [], None
        for factor, table in zip(self.FACTORS, self.tables):
            at = table[((hashes * factor) >> np.uint64(46)).astype(np.int64)]
            used = np.flatnonzero(at >= 0)
            at, hashes = at[used], hashes[used]
            todo = used if todo is None else todo[used]
            hit = self.keys[at] == hashes
            places.append(todo[hit])
            found.append(at[hit])
            todo, hashes = todo[~hit], hashes[~hit]
            if not len(todo):
                break
        return np.concatenate(places), np.concatenate(found)


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Vocabulary:
    return Vocabulary(path, theta)


class Lattices:
    """Forward sums of the distinct units of a batch.

    The units are ranked by size, longest first. Row `base[j] + rank[u]` of the tables describes the end
    after j + 1 characters of unit u, so that all units' ends at one depth are neighbours: the last piece
    has `top` characters with chance `top_share`; `rest` cumulates the chances of all other lengths 1, 2, ...;
    `ids[., L-1]` is the piece of L characters, `spelled` a last character that is no piece.
    """

    def __init__(self, units: list[str], vocab: Vocabulary):
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.vocab, n = vocab, len(text)
        self.size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-self.size, kind="stable")
        self.rank = np.empty(len(units), np.int64)
        self.rank[order] = np.arange(len(units))
        deepest = int(self.size[order[0]]) if len(units) else 0
        # wide[j]: units of more than j characters
        wide = len(units) - np.cumsum(np.bincount(self.size, minlength=deepest + 1))[:deepest] if len(units) else np.zeros(0, np.int64)
        self.base = np.concatenate([[0], np.cumsum(wide)]).astype(np.int64)
        depth = np.arange(n) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        code = np.empty(n, np.uint64)
        code[self.base[depth] + np.repeat(self.rank, self.size)] = text
        del depth, text
        # Row of the character before, in the same unit; at depth 0 there is none.
        up = np.arange(n) - np.repeat(np.concatenate([[0], wide[:-1]]).astype(np.int64)[:len(wide)], wide)
        # Spelled characters, of one character only, are kept apart, so that pieces take two bytes if their ids do.
        self.ids = np.full((n, LONGEST), -1, np.int16 if len(vocab.bytes) <= 1 << 15 else np.int32)
        self.spelled = np.full(n, -1, np.int32)
        weight = np.zeros((n, LONGEST), np.float32)
        own = code + np.uint64(1)
        first, hashes, low, power = np.arange(n), own, 0, np.ones(1, np.uint64)
        for length in range(1, min(LONGEST, deepest) + 1):
            if length > 1:  # rows from `low` on have so many characters up to them
                more = int(self.base[length - 1])
                first, hashes, low = up[first[more - low:]], hashes[more - low:], more
                power = power * vocab.BASE
                hashes = hashes + own[first] * power
            at, found = vocab.find(hashes)
            at += low
            self.ids[at, length - 1] = vocab.ids[found]
            weight[at, length - 1] = vocab.weights[found]
        bare = np.flatnonzero(weight[:, 0] == 0)
        spelled = code[bare].astype(np.int64)
        self.spelled[bare] = np.where(spelled < 128, vocab.byte_ids[spelled % 128], SPELLED + spelled)
        weight[bare, 0] = vocab.least ** _width(spelled)
        del first, hashes, own, code, up
        self._forward(weight, wide, self.size[order], order)

    def _forward(self, weight: np.ndarray, wide: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
        """Chances per end, and the log of all segmentations' weights per unit."""
        window = np.zeros((len(order), LONGEST))  # column d: sum that ends d + 1 characters before
        window[:, 0] = 1.0
        self.top, self.top_share = np.empty(len(weight), np.int8), np.empty(len(weight), np.float32)
        scale, total = np.zeros(len(order)), np.zeros(len(order))
        for j, active in enumerate(wide.tolist()):
            m = min(j + 1, LONGEST)
            rows = slice(int(self.base[j]), int(self.base[j + 1]))
            part = weight[rows, :m] * window[:active, :m]
            here = part.sum(1)
            part /= here[:, None]
            best = part.argmax(1)
            each = np.arange(active)
            self.top[rows], self.top_share[rows] = best + 1, part[each, best]
            part[each, best] = 0.0
            np.cumsum(part, axis=1, out=part)
            weight[rows, :m] = part
            weight[rows, m:] = 2.0  # never drawn
            high = min(m, LONGEST - 1)
            window[:active, 1:high + 1] = window[:active, :high].copy()
            window[:active, 0] = here
            if j % 4 == 3:
                most = window[:active].max(1)
                window[:active] /= most[:, None]
                scale[:active] += np.log(most)
            done = int(wide[j + 1]) if j + 1 < len(wide) else 0  # units from here to `active` end now
            total[done:active] = scale[done:active] + np.log(window[done:active, 0])
        self.rest = weight
        self.log_total = np.empty(len(order))
        self.log_total[order] = total

    def log_weight(self, ids: np.ndarray) -> np.ndarray:
        """Log weight of each piece or spelled character."""
        if not len(ids) or ids.max() < SPELLED:
            return self.vocab.log_weight[ids]
        known = self.vocab.log_weight[np.where(ids < SPELLED, ids, 0)]
        return np.where(ids < SPELLED, known, np.log(self.vocab.least) * _width(ids.astype(np.int64) - SPELLED))

    def draw(self, unit: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each place: ids (first piece first), pieces per place, log chance per place.

        `random` gives each place its own numbers, one per character. The fourth result is the length
        of each piece.
        """
        left, rank = self.size[unit], self.rank[unit]
        start = np.cumsum(left) - left
        steps, count, place = [], np.zeros(len(unit), np.int64), np.arange(len(unit))
        while len(place):
            rows = self.base[left - 1] + rank
            length, over = self.top[rows].astype(np.int64), random[start + (left - 1)] - self.top_share[rows]
            other = np.flatnonzero(over >= 0)
            found = (self.rest[rows[other]] <= over[other][:, None]).sum(1)
            # A number beyond the last chance is due to rounding; the top piece stands for it.
            length[other] = np.where(found < np.minimum(left[other], LONGEST), found + 1, length[other])
            steps.append((place, self.pieces(rows, length), length))
            left = left - length
            count[place[left == 0]] = len(steps)
            more = np.flatnonzero(left)
            place, left, rank, start = place[more], left[more], rank[more], start[more]
        after = np.cumsum(count)
        ids = np.empty(int(after[-1]) if len(after) else 0, np.int32)
        long = np.empty(len(ids), np.int64)
        for step, (p, i, n) in enumerate(steps):
            ids[after[p] - 1 - step] = i
            long[after[p] - 1 - step] = n
        logs = np.concatenate([[0.0], np.cumsum(self.log_weight(ids))])
        chance = np.minimum(logs[after] - logs[after - count] - self.log_total[unit], 0.0)
        return ids, count, chance, long

    def pieces(self, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Id of the piece of `length` characters at each row, or its spelled character."""
        ids = self.ids[rows, length - 1].astype(np.int32)
        none = np.flatnonzero(ids < 0)
        ids[none] = self.spelled[rows[none]]
        return ids

    def path_ids(self, unit: int, path: tuple[int, ...]) -> np.ndarray:
        """Pieces, last first, of a segmentation given by their lengths, last first."""
        ends = self.size[unit] - 1 - np.concatenate([[0], np.cumsum(path)[:-1]]).astype(np.int64)
        return self.pieces(self.base[ends] + self.rank[unit], np.array(path))

    def other_path(self, unit: int, taken: list[tuple[int, ...]], chances: list[float], rng: np.random.Generator) -> tuple[int, ...]:
        """Draw a segmentation of a unit other than those taken (piece lengths, last piece first)."""
        for _ in range(TRIES):
            left, path, mass, alive = int(self.size[unit]), [], 1.0, list(range(len(taken)))
            while left:
                shares = self.shares(unit, left)
                free = [x * mass for x in shares] if alive else shares
                for t in alive:
                    at = taken[t][len(path)] - 1
                    free[at] = 0.0 if len(taken[t]) == len(path) + 1 else max(0.0, free[at] - chances[t])
                ends = list(accumulate(free))
                if ends[-1] <= 0:
                    break  # rounding led into a part with taken paths only
                length = bisect_right(ends, rng.random() * ends[-1]) + 1
                length = min(length, max(i for i, x in enumerate(free) if x) + 1)
                mass *= shares[length - 1]
                alive = [t for t in alive if taken[t][len(path)] == length]
                path.append(length)
                left -= length
            else:
                return tuple(path)
        # What is left is as small as rounding errors: take its likeliest part.
        queue: list[tuple[float, int, tuple[int, ...]]] = [(-1.0, int(self.size[unit]), ())]
        while True:
            mass, left, path = heappop(queue)
            if not left and path not in taken:
                return path
            for at, share in enumerate(self.shares(unit, left)) if left else ():
                if share:
                    heappush(queue, (mass * share, left - at - 1, (*path, at + 1)))

    def shares(self, unit: int, left: int) -> list[float]:
        """Chances of the lengths 1, 2, ... of the piece that ends after `left` characters of a unit."""
        row = int(self.base[left - 1] + self.rank[unit])
        upto = self.rest[row, :left].tolist()
        shares = [b - a for a, b in zip([0.0, *upto], upto)]
        shares[int(self.top[row]) - 1] = float(self.top_share[row])
        return shares


def _largest(values: np.ndarray, most: int) -> list[int]:
    """Places of the `most` largest values."""
    if len(values) <= most:
        return list(range(len(values)))
    return np.argpartition(values, len(values) - most)[len(values) - most:].tolist()


def _units(text: str) -> list[str]:
    if not text:
        return []
    if text[0] == " " or "  " in text or MARK in text or "\0" in text:
        return UNIT.findall(MARK + text.replace(" ", MARK))
    # The same with single spaces, by plain splitting.
    marked = MARK + text.replace(" ", "\0" + MARK)
    if "\n" not in text:
        return marked.split("\0")
    return [u for u in marked.replace("\n", "\0\n\0").split("\0") if u]


def _width(code: np.ndarray) -> np.ndarray:
    """Bytes of a character in UTF-8."""
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def _spell(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Byte pieces in place of the characters that have no piece."""
    at = np.flatnonzero(ids >= SPELLED)
    if not len(at):
        return ids
    parts = np.split(ids, np.sort(np.concatenate([at, at + 1])))
    return np.concatenate([vocab.byte_ids[list(chr(int(p[0]) - SPELLED).encode("utf-8", "surrogatepass"))]
                           if len(p) == 1 and p[0] >= SPELLED else p for p in parts])


def _cut(gumbel: float, top: float) -> float:
    """A Gumbel value, given that it is not above `top`."""
    return float(-np.logaddexp(-top, -gumbel))


def sample_batch(keys: list[str], texts: list[str], vocab: Vocabulary, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to k of (ids, log probability, inclusion score), in the order drawn."""
    parts = list(map(_units, texts))
    known = dict.fromkeys(chain.from_iterable(parts))
    known = dict(zip(known, range(len(known))))
    split = [np.fromiter(map(known.__getitem__, u), np.int64, len(u)) for u in parts]
    lattices = Lattices(list(known), vocab)
    del parts, known
    rngs = [np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed))) for key in keys]

    def draws(which: list[int], froms: list[int]):
        """Fresh segmentations of the units from `froms` on of each document in `which`."""
        parts = [split[d][f:] for d, f in zip(which, froms)]
        unit = np.concatenate(parts) if parts else np.empty(0, np.int64)
        random = [rngs[d].random(int(lattices.size[p].sum()), dtype=np.float32) for d, p in zip(which, parts)]
        ids, count, chance, long = lattices.draw(unit, np.concatenate(random) if random else np.empty(0, np.float32))
        ends, out, at = np.cumsum(count), [], 0
        for p in parts:
            to = at + len(p)
            cut = slice(int(ends[at - 1]) if at else 0, int(ends[to - 1]) if to else 0)
            out.append((ids[cut], count[at:to], chance[at:to], long[cut]))
            at = to
        return out

    results: list[list] = [[] for _ in texts]
    regions: list[list] = [[] for _ in texts]  # (value, parent sample, place, taken paths, their chances)

    def settle(d: int, value: float, sample, start: int) -> None:
        """Record a sample and open the regions that turn off it at its units from `start` on."""
        _, count, chance, long = sample
        before = (np.cumsum(chance) - chance)[start:]
        likely = np.exp(chance[start:])
        with np.errstate(divide="ignore"):
            rest = np.log1p(-likely)
            rest[likely >= 1 - ROUNDING] = -np.inf  # one segmentation only, up to rounding
            # Gumbel values; cutting them off at `value` keeps their order.
            values = before + rest - np.log(-np.log(np.maximum(rngs[d].random(len(chance))[start:], 1e-300)))
        number = len(results[d])
        results[d].append((sample, value, float(chance.sum())))
        for j in _largest(values, k + 1 - number):
            if values[j] > -np.inf:
                i = start + j
                end = int(count[:i + 1].sum())
                path = tuple(long[end - int(count[i]):end][::-1].tolist())
                regions[d].append((_cut(float(values[j]), value), number, i, [path], [float(likely[j])]))

    live = list(range(len(texts)))
    for d, sample in zip(live, draws(live, [0] * len(live))):
        settle(d, float(-np.log(-np.log(max(rngs[d].random(), 1e-300)))), sample, 0)
    for _ in range(k - 1):
        turned = []
        for d in live:
            if not regions[d]:
                continue
            best = max(range(len(regions[d])), key=lambda r: regions[d][r][0])
            turned.append((d, regions[d].pop(best)))
        live = [d for d, _ in turned]
        for (d, (value, parent, i, taken, chances)), fresh in zip(turned, draws(live, [r[2] + 1 for _, r in turned])):
            unit = int(split[d][i])
            path = lattices.other_path(unit, taken, chances, rngs[d])
            ids = lattices.path_ids(unit, path)[::-1]
            logp = min(0.0, float(lattices.log_weight(ids).sum() - lattices.log_total[unit]))
            old = results[d][parent][0]
            upto = int(old[1][:i].sum())
            joined = (np.concatenate([old[0][:upto], ids, fresh[0]]),
                      np.concatenate([old[1][:i], [len(ids)], fresh[1]]),
                      np.concatenate([old[2][:i], [logp], fresh[2]]),
                      np.concatenate([old[3][:upto], path[::-1], fresh[3]]))
            # What is left at this unit: neither the earlier paths nor this one.
            spent, gone = taken + [path], chances + [float(np.exp(logp))]
            mass = 1 - sum(gone)
            if mass > ROUNDING:
                place = float(old[2][:i].sum()) + np.log(mass)
                again = place - np.log(-np.log(max(rngs[d].random(), 1e-300)))
                regions[d].append((_cut(float(again), value), parent, i, spent, gone))
            settle(d, value, joined, i + 1)
    out = []
    for d in range(len(texts)):
        kappa = max((r[0] for r in regions[d]), default=-np.inf)
        out.append([(_spell(s[0], vocab), logp, float(-np.expm1(-np.exp(min(logp - kappa, 700.0)))))
                    for s, _, logp in results[d]])
    return out


def _encode(path: str, k: int, theta: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, theta)
        for batch in released(batches):
            keys = ["" if x is None else str(x) for x in batch.column("_key").to_pylist()]
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            groups, at, size = [], 0, 0
            for i, t in enumerate(texts):  # long texts get smaller groups
                size += len(t)
                if i + 1 - at >= BATCH or size >= GROUP_CHARS or i + 1 == len(texts):
                    groups.append((at, i + 1))
                    at, size = i + 1, 0
            for low, high in groups:
                found = sample_batch(keys[low:high], texts[low:high], vocab, k, seed)
                flat = [s for row in found for s in row]
                take = pa.array(np.repeat(np.arange(low, high), [len(row) for row in found]))
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32),
                                               pa.array(np.concatenate([s[0] for s in flat]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(take) for c in batch.schema.names if c not in ("_key", "_text")],
                    pa.array([i for row in found for i in range(1, len(row) + 1)], pa.int32()), ids,
                    pa.array([s[1] for s in flat]), pa.array([s[2] for s in flat])],
                    names=[*[c for c in batch.schema.names if c not in ("_key", "_text")], "sample", "ids", "log_prob", "inclusion"])
    return run


def sample_encodings(docs: DataFrame, path: str, k: int = SAMPLES, theta: float = THETA, seed: int = 0,
                     key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Up to k rows per row of `docs`: the carried columns, sample (1..k), ids, log_prob, inclusion."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("_text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["sample int, ids array<int>, log_prob double, inclusion double"])
    return rows.mapInArrow(_encode(path, k, theta, seed), schema)


def decoded(path: str, ids: Column) -> Column:
    """The text of an array of ids, as the library decodes it: without the leading space."""
    @arrow_udf("string")
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pa.array(vocabulary(path, THETA).bytes, pa.large_binary())
        for rows in batches:
            flat = pieces.take(rows.flatten())
            ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
            cuts = ends[np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)].tolist()
            data = memoryview(flat.buffers()[2] or b"")
            texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            yield pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())
    return join(ids)
