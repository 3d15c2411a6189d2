"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, their beginnings (for words in many inflections), its pairs of neighbours and its pairs one
word apart, hashed, present or not. Each coordinate
has its own learning rate, and L1 leaves few weights, which are broadcast as two short arrays. The fit runs on the driver over a
bounded sample of labelled rows (`rows_each` for each label). Labels are sampled alike in proportion, so scores keep the base
rate. Scoring reads the whole text.

Defined results: a null or empty text scores by the bias alone; without labels every score is 0.5 of nothing learned, that is the
bias 0; a document with contradicting labels counts as toxic; labels of unknown documents and null labels are left out; rows with
a null id are scored but not learned from; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Ranges, blocks, find_words, lower_ascii, mix, text_buffers
from .decontaminate import row_type
from .samples import SHARES, held_out

CUT = 0.3
#: Beginnings of words, in bytes.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Fit:
    rows: int = 12_000
    text_bytes: int = 1 << 18
    buckets: int = 1 << 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 5
    seed: int = 11


@dataclass
class Model:
    bias: float
    ids: np.ndarray  # sorted
    weights: np.ndarray


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, beginning, pair and pair one word apart of a block."""
    raw, starts = text_buffers(column)
    low = lower_ascii(raw)
    first, end, per_text = find_words(low, starts, ALNUM)
    ranges = Ranges(low.astype(np.uint64) + np.uint64(1))
    words = ranges.of(first, end)
    text = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
    texts, codes = [text], [mix(words)]
    for size in STEMS:
        longer = end - first > size
        texts.append(text[longer])
        codes.append(mix(ranges.of(first[longer], first[longer] + size) + np.uint64(size)))
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        same = text[gap:] == text[: len(text) - gap] if len(text) > gap else np.zeros(0, dtype=bool)
        left, right = words[: len(same)][same], words[gap:][same] if len(same) else words[:0]
        texts.append(text[: len(same)][same])
        codes.append(mix(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(salt)))
    return np.concatenate(texts), (np.concatenate(codes) % np.uint64(buckets)).astype(np.int64)


def fitted(sample: pa.Table, fit: Fit) -> Model:
    """FTRL-proximal, one document a step."""
    z, n = np.zeros(fit.buckets), np.zeros(fit.buckets)
    wanted = sample.column("label").to_pylist()
    column = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    bags = []
    for k in range(sample.num_rows):
        bags.append(np.unique(features(column.slice(k, 1), fit.buckets)[1]).astype(np.int32))
    bias, bias_n = 0.0, 0.0
    random = np.random.default_rng(fit.seed)
    for _ in range(fit.epochs):
        for k in random.permutation(len(bags)):
            ids = bags[k]
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= fit.l1, 0.0, (np.sign(zi) * fit.l1 - zi) / ((fit.beta + np.sqrt(ni)) / fit.alpha + fit.l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - wanted[k]
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / fit.alpha * w
            n[ids] = ni + g * g
            bias_n += g * g
            bias -= fit.alpha * g / (fit.beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= fit.l1, 0.0, (np.sign(z) * fit.l1 - z) / ((fit.beta + np.sqrt(n)) / fit.alpha + fit.l2))
    ids = np.flatnonzero(w)
    return Model(bias, ids, w[ids])


def sampled(docs: DataFrame, labels: DataFrame, fit: Fit, text: str, ident: str, label: str) -> pa.Table:
    """About fit.rows labelled texts, chosen by a hash of the id; only they reach the driver."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{ident}`").isNotNull()).groupBy(F.col(f"`{ident}`").alias("l_id")).agg(F.max(f"`{label}`").alias("label"))
    usable = known.where(~held_out("l_id"))
    total = usable.count()
    share = int(SHARES * min(1.0, fit.rows / max(1, total)))
    few = usable.where(F.pmod(F.xxhash64("l_id"), F.lit(SHARES)) < share)
    rows = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") <= fit.text_bytes)
    return rows.join(few, F.col("id") == F.col("l_id")).select("id", "label", "text").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])


def scored(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), text: str = "text", ident: str = "doc_id", label: str = "toxic", carry: list[str] | None = None) -> DataFrame:
    """docs as `row` with held_out, score and predicted (1 from a score of 0.3)."""
    model = fitted(sampled(docs, labels, fit, text, ident, label), fit)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), held_out(ident).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        m = sent.value
        weights = np.zeros(fit.buckets)
        weights[m.ids] = m.weights
        for block in blocks(batches, 2 << 20):
            doc, bucket = features(block.column("text"), fit.buckets)
            some = weights[bucket] != 0
            pairs = np.unique(doc[some] * np.int64(fit.buckets) + bucket[some])
            total = np.full(block.num_rows, m.bias)
            np.add.at(total, pairs // fit.buckets, weights[pairs % fit.buckets])
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), block.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["row", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"row {row_type(rows)}, held_out boolean, score double, predicted int")
