"""Secret scans: key patterns, and a randomness test battery with false-discovery control.

Patterns find assigned, access and hex secrets. Beside these, every long run of token characters is tested.
A run is split at an inner `=`, so that the value of `NAME=value` is a candidate of its own. A part that mixes `+` or `/`
with `-` or `_` fits no alphabet: it is split once at the first two and once at the last two, and of overlapping parts the
longest that looks random is the candidate, or else the one that comes nearest.
A candidate's encoding is inferred as the smallest alphabet that holds it, and three tests ask whether it looks
drawn evenly from that alphabet: chi-squared for even use of symbol groups, a runs test of symbols
above and below the middle, and the serial correlation of neighbours. Words, numbers and markup fail;
keys do not.

The battery's p-value (Bonferroni's over its three tests) says how well a candidate fits randomness. What is controlled is the
share of ordinary text among the reported secrets, so the null hypothesis is "text": each document gives, for every alphabet and length class
that has candidates which fit at all (`LEAST_FIT`), runs of its own ordinary words written in the style of that alphabet
(`text_like`), which go through the same battery. A candidate's chance under the null is the share of these runs that look at least as random, and the
Benjamini-Hochberg rule at `FDR` rejects "text" within each length class; what it rejects is reported as `random`. Length
matters twice: the least length depends on the alphabet, and each length class has its own null and threshold, as power
grows with length. All tested runs count, those too with too few different symbols, which cannot be reported. Short
runs that text often imitates, alphabets of which the corpus has no text, and corpora too small to
tell a rate from chance yield nothing beyond the patterns.

P-values are counted in classes of equal -log10 p before anything is shuffled (at most `P_CLASSES` rows per alphabet and length
class), so nulls and thresholds are small tables; each document's own candidates stay in its row.

Defined results: null text counts as empty; an empty text has no spans and the digest of the empty
string; repeated rows are scanned one by one; spans are code points, end exclusive; a candidate that
overlaps a pattern's span is left to the pattern.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tillstream.llm.common import bounded_batches, cut_lineage

# The patterns, in the order in which kinds of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18}
HEX_LONG = re.compile(r"[0-9a-f]{16,}")  # a match begins where its run begins

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Alphabet, its symbols in order, and the shortest candidate whose tests have power.
ALPHABETS = (("decimal", "0123456789", 40), ("hex", "0123456789abcdef", 24), ("hex_upper", "0123456789ABCDEF", 24),
             ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24), ("lower", "abcdefghijklmnopqrstuvwxyz0123456789", 24),
             ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20),
             ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
             ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20))
ORDER = {name: {c: i for i, c in enumerate(symbols)} for name, symbols, _ in ALPHABETS}
FDR = 0.05
P_CLASSES = 400  # of 0.05 in -log10 p
STEP = 0.05
RARITY_STEP = 0.01  # the same for chances under the null
PART = re.compile(r"[A-Za-z0-9+/_-]+")
ONE_ALPHABET = (re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9+/]+"))  # parts of a run that no alphabet holds
LEAST_LENGTH = min(least for _, _, least in ALPHABETS)
LOOKS_RANDOM = 0.05
ORDINARY = re.compile(r"[A-Za-z0-9]+")
LONGEST_WORD = 15   # longer ones may be keys themselves
NULL_RUNS = 3       # text-like runs of each text for a cell
LEAST_FIT = 0.001   # what fits randomness worse is not reported, however unlike text it is
NULL_LENGTH = 512   # text of this length never looks random; longer runs are held against it


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def infer_encoding(run: str) -> tuple[str, str, int] | None:
    """Smallest alphabet that holds the run without its padding."""
    body = set(run.rstrip("="))
    return next((a for a in ALPHABETS if body <= ORDER[a[0]].keys()), None)


def _chi_tail(x: float, k: int) -> float:
    """Chance of a chi-squared value of k degrees above x (Wilson and Hilferty)."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(body: str, name: str, symbols: str) -> tuple[float, float, float]:
    """P-values of the chi-squared, runs and serial-correlation tests of a run without padding."""
    at = [ORDER[name][c] for c in body]
    n, size = len(at), len(symbols)
    groups = max(2, min(size, n // 5))
    seen = [0] * groups
    for a in at:
        seen[a * groups // size] += 1
    share = [0] * groups
    for a in range(size):
        share[a * groups // size] += 1
    chi = sum((s - n * w / size) ** 2 / (n * w / size) for s, w in zip(seen, share))
    half = [a * 2 >= size for a in at]
    ones = sum(half)
    runs = 1 + sum(x != y for x, y in zip(half, half[1:]))
    if 0 < ones < n:
        mean = 2 * ones * (n - ones) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(at) / n
    total = sum((a - middle) ** 2 for a in at)
    serial = sum((x - middle) * (y - middle) for x, y in zip(at, at[1:])) / total if total else 1.0
    p_serial = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return _chi_tail(chi, groups - 1), p_runs, p_serial


def varied(body: str, size: int) -> bool:
    """Whether the run has about as many different symbols as chance gives it."""
    n = len(body)
    absent = (1 - 1 / size) ** n
    spread = math.sqrt(max(size * absent * (1 - absent), 0.25))
    return len(set(body)) >= size * (1 - absent) - 3 * spread


def fitness(body: str, name: str, symbols: str) -> float:
    """How well a run fits even draws from its alphabet: the battery's p-value, 0 with too few different symbols."""
    return min(1.0, 3 * min(battery(body, name, symbols))) if varied(body, len(symbols)) else 0.0


def p_class(p: float) -> int:
    return min(P_CLASSES, int(-math.log10(max(p, 1e-300)) / STEP))


def _tested(text: str, start: int, end: int, base: list[tuple[int, int, str]]) -> tuple[int, int, float, int] | None:
    """(start, end, fitness, alphabet) of a part, none if a pattern has it or it cannot be tested."""
    body = text[start:end].rstrip("=")
    kind = infer_encoding(body) if len(body) >= LEAST_LENGTH else None
    if kind is None or len(body) < kind[2] or any(s < end and start < e for s, e, _ in base):
        return None
    return start, end, fitness(body, kind[0], kind[1]), ALPHABETS.index(kind)


def _mixed(text: str, start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int, float, int]]:
    """Tested parts of one alphabet that do not overlap, of a part that no alphabet holds."""
    spans = {m.span() for pattern in ONE_ALPHABET for m in pattern.finditer(text, start, end)}
    padded = end
    while text[padded - 1] == "=":
        padded -= 1
    found = [t for s, e in spans if (t := _tested(text, s, end if e == padded else e, base))]
    kept: list[tuple[int, int, float, int]] = []
    for t in sorted(found, key=lambda t: (-min(t[2], LOOKS_RANDOM), t[0] - t[1], t[0])):
        at = bisect(kept, t)
        if (not at or kept[at - 1][1] <= t[0]) and (at == len(kept) or t[1] <= kept[at][0]):
            kept.insert(at, t)
    return kept


def tested_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, length class, p class, alphabet) of each part of a run that is long enough to test."""
    out = []
    for m in CANDIDATE.finditer(text):
        parts = [p.span() for p in PART.finditer(text, *m.span())]
        for start, stop in parts:
            end = m.end() if (start, stop) == parts[-1] else stop  # padding belongs to the last part
            if infer_encoding(text[start:stop]):
                found = [t] if (t := _tested(text, start, end, base)) else []
            else:
                found = _mixed(text, start, end, base)
            out += [(s, e, (e - s).bit_length(), p_class(p), a) for s, e, p, a in found]
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, p class) of each part of a run that is long enough to test."""
    return [c[:4] for c in tested_parts(text, base)]


def text_like(text: str, alphabet: int, size: int, seed: int) -> str:
    """A run of ordinary words of a text, in the style of an alphabet and of a length of this class; empty if there are too few.

    Words are joined as in names: plainly or with capitals, by dashes, underscores or slashes; alphabets of fewer letters keep
    what they have of them. `seed` picks the place, the length and among styles.
    """
    name, symbols, least = ALPHABETS[alphabet]
    low = max(least, min(1 << (size - 1), NULL_LENGTH))
    length = low + seed % max(min((1 << size) - 1, NULL_LENGTH) - low + 1, 1)
    if name not in ("decimal", "hex", "hex_upper"):  # the others keep few characters and need the whole text
        at = (seed >> 16) % max(len(text) - 4 * length, 1)
        text = text[at:at + 4 * length]
    style = (seed >> 12) & 3
    words = [w for w in ORDINARY.findall(text) if len(w) <= LONGEST_WORD]
    if name in ("hex_upper", "base32"):
        words = [w.upper() for w in words]
    elif name in ("hex", "lower"):
        words = [w.lower() for w in words]
    elif style & 1:
        words = [w.capitalize() for w in words]
    run = ("/" if name == "base64" else "-_"[style >> 1] if name == "base64url" else "").join(words)
    if name in ("decimal", "hex", "hex_upper", "base32"):
        run = "".join(c for c in run if c in ORDER[name])
    return run[:length] if len(run) >= least else ""  # a shorter run looks more random, which is the safe side


def null_runs(text: str, alphabet: int, size: int) -> list[str]:
    """The text-like runs that a text gives, `NULL_RUNS` if it has enough words; equal texts give equal runs."""
    first = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), 64 * alphabet + size)
    return [run for i in range(NULL_RUNS) if (run := text_like(text, alphabet, size, xxhash.xxh3_64_intdigest(first.to_bytes(8, "big"), i)))]


def _null(cells: list[tuple[int, int]]):
    """Counts of (alphabet, length class, p class) over the text-like runs of a task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                for alphabet, size in cells if text else ():
                    for body in null_runs(text, alphabet, size):
                        at = alphabet, size, p_class(fitness(body, *ALPHABETS[alphabet][:2]))
                        counts[at] = counts.get(at, 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], pa.int32()) for i in range(3)] + [pa.array(counts.values(), pa.int64())],
                                             names=["alphabet", "size", "p", "many"])
    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("p", pa.int32()), ("alphabet", pa.int32())]))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    for batch in batches:
        base, digests, tested = [], [], []
        for text in batch.column("_text").to_pylist():
            found = base_spans(text or "")
            base.append([{"start": s, "end": e, "kind": KINDS.index(k)} for s, e, k in found])
            digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest())
            tested.append([dict(zip(("start", "end", "size", "p", "alphabet"), c)) for c in tested_parts(text or "", found)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, spans), pa.array(digests), pa.array(tested, kind)],
                                         names=["doc_id", "base", "base_sha256", "tested"])


def thresholds(found: DataFrame, fdr: float = FDR, step: float = STEP) -> DataFrame:
    """Per length class the smallest p class (of -log10 p) that Benjamini-Hochberg rejects; none: no row."""
    counts = found.select(F.explode("tested").alias("c")).groupBy(F.col("c.size").alias("size"), F.col("c.p").alias("p")).agg(F.count("*").alias("many"))
    whole = Window.partitionBy("size")
    smaller = whole.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select("size", "p", F.sum("many").over(smaller).alias("rank"), F.sum("many").over(whole).alias("total"))
    rejected = F.pow(F.lit(10.0), -F.col("p") * F.lit(step)) <= F.lit(fdr) * F.col("rank") / F.col("total")
    return ranked.filter(rejected).groupBy("size").agg(F.min("p").alias("limit"))


def chances(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Per (alphabet, size, p) of the candidates that fit the class of -log10 of their chance under the null, rounded to the larger chance.

    The chance is (1 + text-like runs whose class is p or less) / (1 + all of them). `texts` has the column _text.
    """
    fits = F.col("p") <= F.lit(p_class(LEAST_FIT))
    each = found.select(F.explode("tested").alias("c")).select("c.alphabet", "c.size", "c.p").filter(fits).distinct()
    seen = cut_lineage(each)  # at most p_class(LEAST_FIT) + 1 rows per alphabet and length class
    cells = [(r["alphabet"], r["size"]) for r in seen.select("alphabet", "size").distinct().collect()]
    null = texts.mapInArrow(_null(sorted(cells)), "alphabet int, size int, p int, many long").groupBy("alphabet", "size", "p").agg(F.sum("many").alias("many"))
    both = null.withColumn("asked", F.lit(0)).unionByName(seen.select("alphabet", "size", "p", F.lit(0).cast("long").alias("many"), F.lit(1).alias("asked")))
    cell = Window.partitionBy("alphabet", "size")
    as_random = F.sum("many").over(cell.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    chance = (as_random + 1) / (F.sum("many").over(cell) + 1)
    return both.select("alphabet", "size", "p", "asked", F.floor(-F.log10(chance) / RARITY_STEP + 1e-9).cast("int").alias("rarity")).filter("asked = 1").drop("asked")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row of `docs`: doc_id, spans (array of start, end, kind), base_sha256."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    scanned = cut_lineage(texts.mapInArrow(_scan, (
        f"doc_id {kind}, base array<struct<start:long,end:long,kind:int>>, base_sha256 string, "
        "tested array<struct<start:long,end:long,size:int,p:int,alphabet:int>>")))
    rare = chances(scanned, texts.select("_text"))
    # Two values: the rarity of each (alphabet, length class, p class) that occurs, and a limit per length class.
    code = (F.col("alphabet") * 64 + F.col("size")) * (P_CLASSES + 1) + F.col("p")
    rarities = rare.agg(F.map_from_entries(F.collect_list(F.struct(code, "rarity"))))
    found = cut_lineage(scanned.withColumn("rarities", rarities.scalar()).withColumn("tested", F.transform("tested", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["size"].alias("size"),
        F.coalesce(F.try_element_at("rarities", (c["alphabet"] * 64 + c["size"]) * (P_CLASSES + 1) + c["p"]), F.lit(-1)).alias("p")))).drop("rarities"))
    limits = thresholds(found, fdr, RARITY_STEP).agg(F.map_from_entries(F.collect_list(F.struct("size", "limit"))))
    joined = found.withColumn("limits", limits.scalar())
    random = F.filter("tested", lambda c: F.coalesce(c["p"] >= F.try_element_at("limits", c["size"]), F.lit(False)))
    extra = F.transform(random, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind")))
    order = F.array_sort(F.concat("base", extra), lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
                         .otherwise(F.signum((x["kind"] - y["kind"]))).cast("int"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind")))
    return joined.select("doc_id", named.alias("spans"), "base_sha256")
