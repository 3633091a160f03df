"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted by SGD in numpy.

A text is the mean of the embeddings of its subwords: each word (a run of letters, lower-cased, with a mark on either
side) gives its byte n-grams of the lengths in `GRAMS`, hashed into `BINS` rows. The mean goes through a linear layer and
a softmax. Embeddings and layer are trained together; for scoring both are folded into one table of scores per subword.

Rejection. A confidence below `threshold` is rejected; the threshold is the quantile `reject_rate` of the confidence
that the true language got on a calibration part of the sample which the weights never saw, after temperature scaling.
The sample holds at most `SAMPLE` rows and `SAMPLE_BYTES` bytes of whole texts.
Cases. A null text, or one without a letter, is `und` with score 0. With no training row every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from palimpsest.llm import scan
from palimpsest.llm.common import add_columns, col
from palimpsest.llm.labels import sample_of

BINS, WIDTH, GRAMS = 1 << 16, 12, (2, 4)
SAMPLE, SAMPLE_BYTES = 3000, 6 << 20
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all subwords of a block, and the bounds of each text's among them."""
    inside = scan.class_table(_LETTERS, True)[data]
    low = np.where(inside, scan.lower_table()[data], np.uint8(32)).astype(np.uint64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bins, owner = [], []
    for size in GRAMS:
        n = len(low) - size + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint64)
        for i in range(size):
            code = (code << np.uint64(8)) | low[i : n + i]
        # A subword holds a letter and lies within one text.
        some = inside[1 : n + 1] if size == 2 else inside[1 : n + 1] | inside[2 : n + 2]
        at = np.flatnonzero(some & (text[:n] == text[size - 1 :]))
        mixed = (code[at] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        bins.append((mixed >> np.uint64(48)).astype(np.int64) & (BINS - 1))
        owner.append(text[at])
    if not bins:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    all_bins, all_owner = np.concatenate(bins), np.concatenate(owner)
    order = np.argsort(all_owner, kind="stable")
    return all_bins[order], np.searchsorted(all_owner[order], np.arange(len(bounds)))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray = field(default_factory=lambda: np.zeros((BINS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bins, ends = subwords(data, bounds)
        counts = np.diff(ends)
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        some = np.flatnonzero(counts > 0)
        if len(some):
            out[some] = np.add.reduceat(self.scores[bins], ends[some], axis=0, dtype=np.float64) / counts[some][:, None]
        return out + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], *, passes: int = 12_000, rate: float = 0.5, reject_rate: float = 0.01, seed: int = 7) -> Model:
    """Mini-batch SGD over `passes` texts, in whole epochs; a fifth of the rows is kept for temperature and threshold."""
    languages = sorted(set(labels))
    if not languages:
        return Model([])
    rng = np.random.default_rng(seed)
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, _, data, bounds in scan.blocks(pa.array(texts, pa.large_string())):
        found, stops = subwords(data, bounds)
        parts.append(found.astype(np.int32))
        sizes.append(np.diff(stops))
    bins, counts = np.concatenate(parts), np.concatenate(sizes)
    ends = np.r_[0, np.cumsum(counts)]
    target = np.searchsorted(languages, labels)
    rows = rng.permutation(np.flatnonzero(counts > 0))
    held, rows = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (BINS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    epochs = -(-passes // max(len(rows), 1))
    steps = max(1, epochs * -(-len(rows) // 16))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), -(-len(rows) // 16) or 1):
            if not len(part):
                continue
            lr = rate * (1 - step / steps)
            step += 1
            own = np.repeat(np.arange(len(part)), counts[part])
            ids = np.concatenate([bins[ends[i] : ends[i + 1]] for i in part])
            mean = np.zeros((len(part), WIDTH), np.float32)
            gathered = embed[ids]
            stops = np.r_[0, np.cumsum(counts[part])]
            mean[:] = np.add.reduceat(gathered, stops[:-1], axis=0) / counts[part][:, None]
            p = softmax(mean @ layer + bias)
            p[np.arange(len(part)), target[part]] -= 1
            grad = p / len(part)
            back = grad @ layer.T
            layer -= lr * (mean.T @ grad)
            bias -= lr * grad.sum(axis=0)
            pair, times = np.unique(ids.astype(np.int64) * len(part) + own, return_counts=True)
            change = back[pair % len(part)] * (times / counts[part][pair % len(part)])[:, None]
            np.subtract.at(embed, pair // len(part), (lr * 20 * change).astype(np.float32))
    model = Model(languages, np.ascontiguousarray(embed @ layer, np.float32), bias.astype(np.float64))
    if len(held):
        z = _rows_logits(model, bins, ends, held)
        model.temperature = min(np.geomspace(0.02, 5, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), target[held]] + 1e-12).mean())
        sure = softmax(z / model.temperature)[np.arange(len(held)), target[held]]
        model.threshold = float(np.quantile(sure, reject_rate))
    return model


def _rows_logits(model: Model, bins: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.array([model.scores[bins[ends[i] : ends[i + 1]]].mean(axis=0) for i in rows]) + model.bias


def fit_language_model(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """A model from at most `sample` documents with a language, outside the held-out fold, of at most `sample_bytes` together."""
    rows = sorted(sample_of(docs, col(lang).cast("string"), text=text, doc_id=doc_id, limit=sample, budget=sample_bytes))
    return fit([t for t, _ in rows], [v for _, v in rows], **options)


def _has_letter(texts: pa.Array) -> np.ndarray:
    """True for the texts with a letter; only those without an ASCII letter are looked into by code points."""
    data, bounds = scan.utf8(texts)
    some = np.r_[0, np.cumsum(scan.class_table(_LETTERS[:52], True)[data])]
    found = some[bounds[1:]] > some[bounds[:-1]]
    for i in np.flatnonzero(~found & (np.diff(bounds) > 0)).tolist():
        found[i] = any(map(str.isalpha, texts[i].as_py()))
    return found


def identify_language(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the probability of lang_pred) and rejected (score below the calibrated threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]

    def make():
        m = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            letters = _has_letter(texts)
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            if m.languages:
                for a, b, data, bounds in scan.blocks(texts):
                    p = softmax(m.logits(data, bounds) / m.temperature)
                    best[a:b], score[a:b] = p.argmax(axis=1), p.max(axis=1)
            else:
                letters[:] = False
            names = [m.languages[i] if ok else "und" for i, ok in zip(best, letters)]
            score = np.where(letters, score, 0.0)
            return [pa.array(names, pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold))]

        return compute

    return add_columns(docs, text, fields, make)
