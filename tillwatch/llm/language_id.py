"""Language identification: averaged embeddings of hashed subwords with a linear softmax, trained by stochastic gradient descent.

Subwords are byte n-grams of the lower-cased text. The model is two small tables, fitted in numpy on the driver on a bounded
sample of labelled rows (`rows_each` of every label, `most_rows` and `most_bytes` in all), and broadcast. A fifth of the sample
calibrates: a temperature for the probabilities, and the score under which a prediction counts as rejected so that the accepted
ones keep the wanted accuracy. Prediction averages over all subwords of the whole text.

Defined results: `und` with score 0 for null texts, texts without a letter, and if nothing could be learned; repeated rows are
predicted alike; rows with a null id are predicted but not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lower_ascii, mix, text_buffers
from .decontaminate import row_type
from .samples import held_out, labelled_sample

GRAMS = (2, 3, 4)


@dataclass(frozen=True)
class Fit:
    rows_each: int = 1500
    most_rows: int = 30_000
    most_bytes: int = 128 << 20
    buckets: int = 1 << 15
    width: int = 8
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7
    accuracy: float = 0.99


@dataclass
class Model:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float


def subwords(raw: np.ndarray, starts: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: the buckets of the n-grams of all texts, and where each text's begin (one more entry for the end)."""
    low = lower_ascii(raw).astype(np.uint64) + np.uint64(1)
    found = []
    for n in GRAMS:
        size = max(len(low) - n + 1, 0)
        code = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + low[k : k + size]
        valid = np.ones(size, dtype=bool)
        for k in range(1, n):  # not across two texts
            edge = starts[1:-1] - k
            valid[edge[(edge >= 0) & (edge < size)]] = False
        grams = (mix(code[valid] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(valid)])
        found.append((grams, before[np.minimum(starts, size)]))
    return found


def means(raw: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The average embedding of each text."""
    total, count = np.zeros((len(starts) - 1, table.shape[1])), np.zeros(len(starts) - 1)
    for grams, at in subwords(raw, starts, len(table)):
        n = np.diff(at)
        some = np.flatnonzero(n)
        if len(some):
            total[some] += np.add.reduceat(table[grams], at[some], axis=0)
            count += n
    return total / np.maximum(count, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fitted(sample: pa.Table, fit: Fit) -> Model | None:
    labels = sorted(set(sample.column("label").to_pylist()))
    if not labels:
        return None
    number = {x: k for k, x in enumerate(labels)}
    wanted = np.array([number[x] for x in sample.column("label").to_pylist()])
    texts = sample.column("text").to_pylist()
    features = []
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        grams = np.concatenate([g for g, _ in subwords(raw, np.array([0, len(raw)]), fit.buckets)])
        ids, n = np.unique(grams, return_counts=True)
        features.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)[:, None]))
    random = np.random.default_rng(fit.seed)
    table = random.normal(0, 0.1, (fit.buckets, fit.width)).astype(np.float32)
    weights, bias = np.zeros((fit.width, len(labels)), dtype=np.float32), np.zeros(len(labels), dtype=np.float32)
    order = random.permutation(len(texts))
    aside, train = order[: len(order) // 5], order[len(order) // 5 :]
    steps, done = fit.epochs * max(1, len(train)), 0
    for _ in range(fit.epochs):
        for k in random.permutation(train):
            ids, share = features[k]
            if not len(ids):
                continue
            rate = fit.rate * (1 - done / steps)
            done += 1
            mean = (table[ids] * share).sum(axis=0)
            error = softmax(mean @ weights + bias)
            error[wanted[k]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            table[ids] -= (rate * len(ids)) ** 0.5 * 4 * share * back  # rare subwords of long texts still move
    logits = np.array([(table[features[k][0]] * features[k][1]).sum(axis=0) @ weights + bias for k in aside]) if len(aside) else np.zeros((0, len(labels)))
    temperature, accept = 1.0, 0.0
    if len(aside):
        loss = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(aside)), wanted[aside]], 1e-9)).mean() for t in np.geomspace(0.1, 10, 41)}
        temperature = float(min(loss, key=loss.get))
        sure = softmax(logits / temperature)
        right, top = sure.argmax(axis=1) == wanted[aside], sure.max(axis=1)
        by = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[by]) >= fit.accuracy * np.arange(1, len(by) + 1))
        accept = float(top[by][good[-1]]) if len(good) else 1.0
    return Model(labels, table, weights, bias, temperature, accept)


def predicted(docs: DataFrame, fit: Fit = Fit(), text: str = "text", lang: str = "lang", ident: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """docs as `row` with held_out, lang_pred, score (calibrated probability) and rejected."""
    learn = docs.where(~held_out(ident) & F.col(f"`{ident}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    model = fitted(labelled_sample(learn.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{lang}`").alias("label"), F.col(f"`{text}`").alias("text")), fit.rows_each, fit.most_rows, fit.most_bytes), fit)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), held_out(ident).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        m = sent.value
        for block in blocks(batches, 1 << 20):
            texts = block.column("text").to_pylist()
            ok = np.array([m is not None and t is not None and any(c.isalpha() for c in t) for t in texts])
            names, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            if m is not None:
                raw, starts = text_buffers(block.column("text"))
                sure = softmax((means(raw, starts, m.embeddings) @ m.weights + m.bias) / m.temperature)
                best, top = sure.argmax(axis=1), sure.max(axis=1)
                for k in np.flatnonzero(ok).tolist():
                    names[k] = m.labels[best[k]]
                scores[ok], rejected[ok] = np.clip(top[ok], 0, 1), top[ok] < m.accept
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), block.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                ["row", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"row {row_type(rows)}, held_out boolean, lang_pred string, score double, rejected boolean")
