"""Language identification by averaged hashed subword embeddings.

Features of a text are its letter runs' subwords of 2 to 4 bytes with word
borders, and its short words, hashed into ``buckets``. The model averages their
embeddings and applies a linear softmax; both are trained by stochastic gradient
descent in numpy on the driver, over a sample of labelled documents of at most
about ``per_language`` rows of each language (a documented bound; the rows are
chosen by a hash of the id). A part of the sample that training leaves out sets a
temperature, so that scores are calibrated, and the rejection limit: the score
below which fewer than ``precision`` of its documents were right.

A linear softmax of an average is the average of a table of logits, so workers
hold ``buckets`` x languages numbers and predict whole texts in one pass.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; if
no row can be learned from, every text is ``und``; repeated rows get a row each;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import BYTE_VALUES, chunks, mix, utf8

UND = "und"
LETTER = r"\p{L}"


def _folded() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = out[97:123]
    out[128:] = np.arange(128, 256)
    return out


#: Letters in lower case, bytes of non-ASCII as they are, and spaces for all else.
FOLDED = _folded()
MAX_GRAM = 4


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the rows, and where each row's begin; each row is read whole."""
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, 32, np.uint8)  # a space before each row and after the last
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    text[place] = FOLDED[data]
    upper = (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3) & (text[1:] != 0x97)
    text[1:][upper] += 0x20
    space = text == 32
    value = BYTE_VALUES[text]
    outs, rows = [], []
    row_of = np.repeat(np.arange(n + 1), np.append(np.diff(offsets) + 1, 1))
    h = value.copy()
    m = len(text)
    for g in range(2, MAX_GRAM + 1):
        h = h[: m - g + 1] * np.uint64(0x9E3779B97F4A7C15) + value[g - 1 :]
        ok = ~(space[: m - g + 1] & space[g - 1 :])
        for j in range(1, g - 1):
            ok &= ~space[j : m - g + 1 + j]
        if g == 2:
            ok &= ~space[:-1] | ~space[1:]
        at = np.flatnonzero(ok)
        at = at[row_of[at] < n]
        outs.append((mix(h[at] + np.uint64(g)) & np.uint64(buckets - 1)).astype(np.int32))
        rows.append(row_of[at])
    bucket, row = np.concatenate(outs), np.concatenate(rows)
    order = np.argsort(row, kind="stable") if n > 1 else slice(None)
    bucket, row = bucket[order], row[order]
    return bucket, np.searchsorted(row, np.arange(n + 1))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages
    temperature: float
    reject_below: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, subwords) of each row."""
        bucket, at = features(data, offsets, len(self.logits))
        n = len(at) - 1
        total = np.zeros((n, len(self.languages)))
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            total[full] = np.add.reduceat(self.logits[bucket], at[full], axis=0)
        count = np.diff(at)
        z = total / np.maximum(count, 1)[:, None] / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1), count


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], *, buckets: int = 1 << 16, dim: int = 16, epochs: int = 12, batch: int = 32, draw: int = 160, rate: float = 0.6, precision: float = 0.9, seed: int = 7) -> Model | None:
    """Train on whole texts; a step draws ``draw`` subwords of each of its texts."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    data, offsets = utf8(pa.array(texts, pa.string()))
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets) for i, j in chunks(offsets)]
    docs = [b[at[r] : at[r + 1]] for b, at in parts for r in range(len(at) - 1)]
    y = np.array([names.index(x) for x in labels])
    good = np.array([len(d) > 0 for d in docs], bool)
    order = rng.permutation(np.flatnonzero(good))
    if not len(order):
        return None
    held = order[: len(order) // 10] if len(order) >= 50 else order[:0]
    own = order[len(held) :]
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    w = np.zeros((dim, len(names)), np.float32)
    steps = max(1, epochs * max(1, len(own) // batch))
    steps, t = max(steps, 200), 0
    while t < steps:
        for i in range(0, len(own), batch):
            rows = rng.choice(own, min(batch, len(own)), replace=False)
            lr = rate * (1 - t / steps)
            pick = np.stack([docs[r][rng.integers(0, len(docs[r]), draw)] for r in rows])
            mean = emb[pick].mean(axis=1)
            p = _softmax(mean @ w)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ w.T) / draw
            w -= lr * (mean.T @ p) * 4
            flat = pick.ravel()
            uniq, inverse = np.unique(flat, return_inverse=True)
            step = np.repeat(back, draw, axis=0)
            grad = np.stack([np.bincount(inverse, weights=step[:, d], minlength=len(uniq)) for d in range(dim)], axis=1)
            emb[uniq] -= (lr * 40 * grad).astype(np.float32)
            t += 1
            if t >= steps:
                break
    model = Model(names, (emb @ w).astype(np.float32), 1.0, 0.0)
    if len(held):
        z = np.stack([model.logits[docs[r]].mean(axis=0) for r in held])
        doubt = 1 / (len(held) + 2)  # a label is not held for more certain than so many documents can show

        def loss(t: float) -> float:
            logp = np.log(_softmax(z / t) + 1e-12)
            return -((1 - doubt) * logp[np.arange(len(held)), y[held]] + doubt * logp.mean(axis=1)).mean()

        model.temperature = min(np.geomspace(0.02, 5, 60), key=loss)
        p = _softmax(z / model.temperature)
        right, top = p.argmax(axis=1) == y[held], p.max(axis=1)
        for limit in np.linspace(0.2, 0.99, 80):
            if right[top >= limit].mean() >= precision if (top >= limit).any() else True:
                model.reject_below = float(limit) if limit > 0.2 else 0.0
                break
    return model


def fit(docs: DataFrame, *, learnable, text_col: str = "text", lang_col: str = "lang", doc_col: str = "doc_id", per_language: int = 900, **options) -> Model | None:
    """Train on rows where ``learnable`` holds and text and language are not null."""
    rows = docs.where(learnable).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = rows.groupBy(lang_col).count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r[0], F.lit(min(1.0, per_language / r[1]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(doc_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share).select(F.col(doc_col).alias("d"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).collect()
    sample.sort(key=lambda r: (str(r.d), r.t))
    return train([r.t for r in sample], [r.l for r in sample], **options)


def _predictor(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                part = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(np.ascontiguousarray(offsets[i : j + 1] - offsets[i])), pa.py_buffer(data[offsets[i] : offsets[j]]))
                letter = pc.match_substring_regex(part, LETTER).to_numpy(zero_copy_only=False)
                names, score, reject = np.full(j - i, UND, object), np.zeros(j - i), np.ones(j - i, bool)
                if model is not None:
                    top, p, _ = model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    names[letter] = np.array(model.languages, object)[top[letter]]
                    score[letter] = p[letter]
                    reject = ~letter | (score < model.reject_below)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(reject)], names=["key", "lang_pred", "score", "rejected"])

    return predict


def predict(docs: DataFrame, model: Model | None, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row of ``docs``."""
    kind = dict(docs.dtypes)[doc_col]
    rows = docs.select(F.col(doc_col).alias("key"), F.col(text_col))
    return rows.mapInArrow(_predictor(model), f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", doc_col)


def fold(doc_col: str, parts: int):
    """The remainder of crc32 of the id's text: which fold a row is in."""
    return F.crc32(F.col(doc_col).cast("string")) % parts
