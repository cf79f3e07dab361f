"""Quality rules by labelling lines: a linear-chain conditional random field marks content and boilerplate.

A text is its lines. Each has a few shares and flags (`FEATURES`); the field adds a weight per feature
and label, and one per pair of neighbouring labels, so that a doubtful line follows its neighbours.
Viterbi decoding gives the best labelling; a document is kept if at least `SHARE` of the characters
in lines with words are content and no base rule fails.

Weights are trained here by gradient steps on the likelihood (forward-backward), on a bounded sample of
`PER_CLASS` documents of each quality label, smallest hash of the id first; a line's label is that of its
document. Each training chain is a text with one of the other label set into its middle, so that the pair weights see
changes of label in both directions. Labelling is one narrow pass over whole texts, vectorised per Arrow batch.

Defined results: null text counts as empty; an empty or blank text has no words, fails the base rules
and is not kept; without labels of both kinds every line is content; repeated rows are labelled one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillstream.llm.common import WordHashes, bounded_batches, broadcast_if_small, cut_lineage, ngram_hashes

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent
SHARE = 0.5
PER_CLASS = 1500
EPOCHS = 4
RATE = 0.2
SEED = 23
FEATURES = ("always", "no words", "upper", "digits", "symbols", "marks", "exclaims", "other", "short", "long",
            "long words", "repeats a line", "sentence end", "first", "last")

# Classes of bytes: white space, line break, letters, upper case, digits, listed symbols, sentence ends,
# exclamation marks, other ASCII marks, later bytes of a character.
_WHITE, _BREAK, _LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _EXCLAIM, _MARK, _LATER = range(10)


def _classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    for byte in range(256):
        c = chr(byte)
        if byte >= 0x80:
            out[byte] = _LATER if byte < 0xC0 else _LOWER
        elif c.isalpha():
            out[byte] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            out[byte] = _DIGIT
    for chars, kind in ((" \t\x0b\x0c\r", _WHITE), ("\n", _BREAK), ("#*$%&|<>", _SYMBOL), (".?", _STOP), ("!", _EXCLAIM)):
        for c in chars:
            out[ord(c)] = kind
    return out


CLASS = _classes()


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows of `size` words that are found twice or more."""
    if len(hashes) <= size:
        return 0
    grams = ngram_hashes(hashes, size)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


class Lines:
    """Counts per document and features per line of a batch of texts."""

    def __init__(self, texts: list[str], words: WordHashes):
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        kind = CLASS[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
        ends = kind == _BREAK
        n_lines = np.array([t.count(b"\n") + 1 for t in data], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(n_lines)])
        total = int(self.cuts[-1])
        line = np.cumsum(ends) - ends
        counts = np.bincount(line * 10 + kind, minlength=total * 10).reshape(total, 10)
        blank = kind <= _BREAK
        starts = ~blank & np.concatenate([[True], blank[:-1]])
        line_words = np.bincount(line[starts], minlength=total)
        word_chars = counts.sum(1) - counts[:, _WHITE] - counts[:, _BREAK] - counts[:, _LATER]
        last = np.full(total, _WHITE, np.uint8)  # class of the last byte that is not white space
        seen = np.flatnonzero(~blank)
        last[line[seen]] = kind[seen]
        self.repeats = np.concatenate([self._repeats(d) for d in data]) if data else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(data)), n_lines)
        per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(data)).astype(np.int64)
        self.n_words, self.word_chars = per_doc(line_words), per_doc(word_chars)
        self.n_symbols, self.n_dup_lines = per_doc(counts[:, _SYMBOL]), per_doc(self.repeats)
        self.n_repeat_words = np.array([repeated_words(words.of(d.split())) for d in data], np.int64)
        self.chars = word_chars
        size = np.maximum(word_chars, 1)
        place = np.arange(total) - self.cuts[doc]
        self.features = np.stack([
            np.ones(total), line_words == 0, counts[:, _UPPER] / size, counts[:, _DIGIT] / size,
            np.minimum(4 * counts[:, _SYMBOL] / size, 1), np.minimum(4 * counts[:, _MARK] / size, 1),
            np.minimum(4 * counts[:, _EXCLAIM] / size, 1), counts[:, _LATER] / size, line_words < 4, line_words > 200,
            word_chars > 12 * np.maximum(line_words, 1), self.repeats, last == _STOP, place == 0,
            place == n_lines[doc] - 1], axis=1).astype(np.float64)

    @staticmethod
    def _repeats(data: bytes) -> np.ndarray:
        """Whether each line has a word and equals an earlier one."""
        seen: set[bytes] = set()
        out = []
        for line in data.split(b"\n"):
            out.append(line in seen and bool(line.strip(b" \t\x0b\x0c\r")))
            seen.add(line)
        return np.array(out, bool)


def viterbi(scores: list[list[float]], pairs: list[list[float]]) -> list[int]:
    """Best labels of a chain of lines: scores per line and label, weights per pair of labels."""
    (t00, t01), (t10, t11) = pairs
    a, b = scores[0]
    back = []
    for e0, e1 in scores[1:]:
        from0 = (a + t00 < b + t10, a + t01 < b + t11)
        a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
        back.append(from0)
    at = int(b > a)
    labels = [at]
    for choice in reversed(back):
        at = int(choice[at])
        labels.append(at)
    return labels[::-1]


def chain_gradient(scores: np.ndarray, pairs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the log likelihood by line scores and by pair weights, and the log likelihood."""
    n = len(scores)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for i in range(1, n):
        forward[i] = scores[i] + np.logaddexp(forward[i - 1, 0] + pairs[0], forward[i - 1, 1] + pairs[1])
    for i in range(n - 2, -1, -1):
        after = scores[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(pairs[:, 0] + after[0], pairs[:, 1] + after[1])
    total = np.logaddexp(*forward[-1])
    by_line = -np.exp(forward + backward - total)
    by_line[np.arange(n), labels] += 1
    both = np.zeros((2, 2))
    likely = scores[np.arange(n), labels].sum() - total
    if n > 1:
        joint = forward[:-1, :, None] + pairs[None] + (scores[1:] + backward[1:])[:, None, :] - total
        both -= np.exp(joint).sum(0)
        np.add.at(both, (labels[:-1], labels[1:]), 1)
        likely += pairs[labels[:-1], labels[1:]].sum()
    return by_line, both, float(likely)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Weights per feature and label and per pair of labels, from (features, labels) of the lines."""
    weights, pairs = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    squares, pair_squares = np.full_like(weights, 1e-3), np.full_like(pairs, 1e-3)
    for _ in range(epochs):
        for features, labels in rows:
            by_line, both, _ = chain_gradient(features @ weights, pairs, labels)
            step = features.T @ by_line / len(features) - 1e-4 * weights
            both = both / len(features)
            squares += step ** 2
            pair_squares += both ** 2
            weights += rate * step / np.sqrt(squares)
            pairs += rate * both / np.sqrt(pair_squares)
    return weights, pairs


def mixed_chains(rows: list[tuple[str, int]]) -> list[tuple[str, np.ndarray]]:
    """(text, label of each line): texts with one of the other label in the middle, in turn; the rarer label is used again."""
    kinds = [[t.split("\n") for t, y in rows if y == label] for label in (0, 1)]
    out = []
    for i in range(max(map(len, kinds)) if all(kinds) else 0):
        outer = i % 2
        host, guest = (kinds[y][i % len(kinds[y])] for y in (outer, 1 - outer))
        at = (len(host) + i // 2 % 2) // 2  # of an even number of lines the middle, of others either side of it
        labels = np.full(len(host) + len(guest), outer)
        labels[at:at + len(guest)] = 1 - outer
        out.append(("\n".join(host[:at] + guest + host[at:]), labels))
    return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += [(t or "", y) for t, y in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist())]
    words = WordHashes()
    weights, pairs = fit([(Lines([text], words).features, labels) for text, labels in mixed_chains(rows)])
    yield pa.RecordBatch.from_arrays([pa.array([weights.ravel().tolist()]), pa.array([pairs.ravel().tolist()])], names=["weights", "pairs"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[float], list[float]]:
    """Weights from the labelled sample, flat; without both labels, those that call every line content."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1)).withColumn(
        "order", F.xxhash64(F.lit(SEED), "doc_id"))
    picked = [known.filter(F.col("quality") == y).orderBy("order", "doc_id").limit(per_class) for y in (0, 1)]
    sample = broadcast_if_small(cut_lineage(picked[0].unionByName(picked[1])), 2 * per_class)
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    if texts.agg(F.count_distinct("quality")).first()[0] < 2:
        return [0.0, 1.0] + [0.0] * (2 * len(FEATURES) - 2), [0.0] * 4
    one = texts.select("order", "text", "quality").repartition(1).sortWithinPartitions("order", "quality", "text")
    model = one.mapInArrow(_train, "weights array<double>, pairs array<double>").first()
    return list(model["weights"]), list(model["pairs"])


def _label(weights: list[float], pairs: list[float], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = np.array(weights).reshape(len(FEATURES), 2)
        between = np.array(pairs).reshape(2, 2).tolist()
        words = WordHashes()
        for batch in batches:
            lines = Lines([t or "" for t in batch.column("_text").to_pylist()], words)
            scores = (lines.features @ emission).tolist()
            labels = [x for a, b in zip(lines.cuts.tolist(), lines.cuts[1:].tolist()) for x in viterbi(scores[a:b], between)]
            content = lines.chars * np.array(labels, np.int64)
            sums = np.concatenate([[0], np.cumsum(content)])
            inside = (sums[lines.cuts[1:]] - sums[lines.cuts[:-1]]) / np.maximum(lines.word_chars, 1)
            failed = (lines.n_words < LEAST_WORDS) | (100 * lines.n_repeat_words > MOST_REPEATED * lines.n_words)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array(x) for x in (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines,
                                                                lines.n_repeat_words, failed, ~failed & (inside >= share), inside)]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])
    return run


def quality(docs: DataFrame, labels: DataFrame, share: float = SHARE, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of `docs`: doc_id, the counts, base_failed, kept, content_share."""
    bounded_batches(docs.sparkSession)
    weights, pairs = train(docs, labels, per_class)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(_label(weights, pairs, share), (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double"))
