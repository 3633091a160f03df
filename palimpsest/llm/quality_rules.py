"""Quality rules: fixed thresholds on counts of a document, then a hashed n-gram logistic regression.

Base rules: `n_words` under `MIN_WORDS`, or more than half the words in three-word windows that recur in the text, fail.
The model sees hashed words, pairs of neighbouring words and 4-grams of code points, each family as relative frequencies,
in `BINS` weights. It is fitted on a sample of labelled rows (at most `SAMPLE` rows and `SAMPLE_BYTES` bytes of whole
texts), calibrated by Platt scaling on a part it never saw, and scored in Arrow batches. A document is kept if it passes
the base rules and its probability reaches `KEEP`.

Words are `[^\\x20\\x09-\\x0D]+`. Cases: a null or empty text has no words and fails; of equal lines the first is not a
repeat; lines without a word are never repeats; with no training row, or one label only, the base rules decide alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from palimpsest.llm import scan
from palimpsest.llm.common import SPACES, add_columns
from palimpsest.llm.labels import sample_with

BINS = 1 << 16
SAMPLE, SAMPLE_BYTES = 6000, 12 << 20
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP = 50, 50, 0.3
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_block(data: np.ndarray, bounds: np.ndarray) -> tuple[scan.Words, dict[str, np.ndarray]]:
    """The base counts of each text of a block."""
    words = scan.Words(data, bounds, scan.class_table(SPACES, False))
    in_word = scan.class_table(SPACES, False)[data]
    starts_char = (data & 0xC0) != 0x80  # UTF-8 continuation bytes don't start a code point
    return words, {
        "n_words": words.counts,
        "word_chars": scan.sums(in_word & starts_char, bounds),
        "n_symbols": scan.sums(scan.class_table(SYMBOLS, True)[data], bounds),
        "n_dup_lines": _repeated_lines(data, bounds, in_word),
        "n_repeat_words": _repeated_words(words),
    }


def _repeated_lines(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[bounds[:-1], newline + 1])
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(bounds) - 1, np.int64)
    ends = np.r_[starts[1:], len(data)]
    ends = ends - (data[ends - 1] == 10)
    some = np.r_[0, np.cumsum(in_word)]
    full = np.flatnonzero(some[ends] > some[starts])
    roll = scan.Rolling(scan.byte_values(0)[data])
    text = np.searchsorted(bounds, starts[full], "right") - 1
    h = roll.of(starts[full], ends[full]) + np.uint64(0x9E3779B97F4A7C15) * text.astype(np.uint64)
    _, group, times = np.unique(h, return_inverse=True, return_counts=True)
    # Lines of equal hash are compared by their bytes: a polynomial modulo 2**64 has collisions of long lines.
    seen, repeats = set(), np.zeros(len(bounds) - 1, np.int64)
    for i in np.flatnonzero(times[group] > 1).tolist():
        line = (text[i], data[starts[full[i]] : ends[full[i]]].tobytes())
        repeats[text[i]] += line in seen
        seen.add(line)
    return repeats


def _repeated_words(words: scan.Words) -> np.ndarray:
    h = scan.Rolling(words.hashes()).windows(3)
    at = np.flatnonzero(words.within(3))
    marked = np.zeros(len(words) + 1, np.int64)
    if len(at):
        own = words.owner()[at].astype(np.uint64)
        _, group, times = np.unique(h[at] + np.uint64(0x9E3779B97F4A7C15) * own, return_inverse=True, return_counts=True)
        again = at[times[group] > 1]
        np.add.at(marked, again, 1)
        np.add.at(marked, again + 3, -1)
    return scan.sums(np.cumsum(marked)[:-1] > 0, words.bounds)


def _code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point (its bytes), and each text's bounds among them."""
    first = (data & 0xC0) != 0x80
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(data)])
    padded = np.r_[data, np.zeros(4, np.uint8)].astype(np.uint64)
    code = padded[at]
    for i in (1, 2, 3):
        code |= np.where(size > i, padded[at + i], np.uint64(0)) << np.uint64(8 * i)
    return code, np.searchsorted(at, bounds)


def features(words: scan.Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family of n-grams (words, pairs of words, 4-grams of code points): bins, and each text's bounds among them."""
    quarter, half, odd = np.uint64(BINS // 4 - 1), np.uint64(BINS // 2 - 1), np.uint64(0x9E3779B97F4A7C15)
    h, b = words.hashes(), words.bounds
    pairs = scan.mix(h[:-1] * odd + h[1:]) & quarter
    code, at = _code_points(words.data, words.text_bounds)
    n = max(len(code) - 3, 0)
    gram = code[:n]
    for i in (1, 2, 3):
        gram = gram * odd + code[i : n + i]
    # Grams that reach into the next text are not counted.
    ends = lambda bounds, size, most: np.minimum(np.maximum(bounds[1:] - (size - 1), bounds[:-1]), most)
    starts = lambda bounds, most: np.minimum(bounds[:-1], most)
    return [
        ((h & quarter).astype(np.int64), b[:-1], b[1:]),
        (pairs.astype(np.int64) + BINS // 4, starts(b, len(pairs)), ends(b, 2, len(pairs))),
        ((scan.mix(gram) & half).astype(np.int64) + BINS // 2, starts(at, n), ends(at, 4, n)),
    ]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, words: scan.Words) -> np.ndarray:
        z = np.full(len(words.counts), self.bias)
        for bins, starts, stops in features(words):
            total = np.r_[0.0, np.cumsum(self.weights[bins], dtype=np.float64)]
            z += (total[stops] - total[starts]) / np.maximum(stops - starts, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))


def fit(texts: list[str], labels: list[int], *, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> Model | None:
    """SGD with AdaGrad steps on balanced log loss; Platt scaling on a fifth of the rows. None without two labels."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    rows = []
    for _, _, data, bounds in scan.blocks(pa.array(texts, pa.large_string())):
        families = features(scan.Words(data, bounds, scan.class_table(SPACES, False)))
        for i in range(len(bounds) - 1):
            found = [np.unique(bins[starts[i] : stops[i]], return_counts=True) for bins, starts, stops in families]
            shares = [c / max(stops[i] - starts[i], 1) for (_, c), (_, starts, stops) in zip(found, families)]
            rows.append((np.concatenate([u for u, _ in found]).astype(np.int32), np.concatenate(shares).astype(np.float32)))
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    share = np.clip(y[train].mean(), 0.01, 0.99)
    w, seen, bias = np.zeros(BINS), np.full(BINS, 1e-8), 0.0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[ids] @ x + bias, -30, 30)))
            g = (p - y[i]) * (0.5 / share if y[i] else 0.5 / (1 - share))
            step = g * x
            seen[ids] += step * step
            w[ids] -= rate * step / np.sqrt(seen[ids])
            bias -= 0.02 * g
    model = Model(w.astype(np.float32), bias)
    z = np.array([w[rows[i][0]] @ rows[i][1] + bias for i in held])
    model.slope, model.shift = platt(z, y[held])
    return model


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with smoothed targets; (1, 0) without both labels."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[z, np.ones(len(z))]
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - t) + 1e-3 * b
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        b -= np.clip(move, -2, 2)
    return float(b[0]), float(b[1])


def fit_quality_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **options) -> Model | None:
    """A model from at most `sample` labelled documents outside the held-out fold, of at most `sample_bytes` together."""
    rows = sorted(sample_with(docs, labels, "quality", text=text, doc_id=doc_id, limit=sample, budget=sample_bytes))
    return fit([t for t, _ in rows], [int(v) for _, v in rows], **options)


def apply_quality_rules(docs: DataFrame, model: Model | None, *, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with the base counts, base_failed, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField(n, LongType()) for n in COUNTS] + [
        StructField("base_failed", BooleanType()), StructField("score", DoubleType()), StructField("kept", BooleanType())]

    def make():
        m = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = {n: [np.zeros(0, np.int64)] for n in COUNTS}
            scores = [np.zeros(0)]
            for _, _, data, bounds in scan.blocks(texts):
                words, counts = count_block(data, bounds)
                for n in COUNTS:
                    found[n].append(counts[n].astype(np.int64))
                scores.append(np.ones(len(bounds) - 1) if m is None else m.probability(words))
            c = {n: np.concatenate(v) for n, v in found.items()}
            score = np.concatenate(scores)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            return [pa.array(c[n]) for n in COUNTS] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))]

        return compute

    return add_columns(docs, text, fields, make)
