"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web texts minimise the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with logistic loss, prior being the estimated share of good texts. Inputs are
figures of a whole text's shape: character classes, repeats of words and lines, and
lengths. Labels, language, source and id are never inputs of a score.

The fit uses a bounded sample (SAMPLE_ROWS positives and as many unlabelled texts,
in the order of a hash of their ids); every text is scored.

Defined results: null and empty texts are scored like any other, by the figures of
an empty text. Without a trusted positive there is nothing to learn: every score is
the prior. Repeated rows and ties give equal scores; a row with a null id is never
held out; extra columns are carried only where asked for; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, bounded_batches, split_columns, text_or_empty

#: Trusted positives, and unlabelled texts, that the fit takes at most.
SAMPLE_ROWS = 12_000
PREDICT_FROM = 0.7
#: The fold of crc32(id as text) mod FOLDS that labels are never learnt from.
FOLDS, HELD_OUT_FOLD = 4, 2
DEFAULT_PRIOR = 0.5
STEPS = 400
RATE = 0.05
PENALTY = 1e-4
HIDDEN = 16

#: Byte classes counted by share of all bytes.
CLASSES = tuple(np.isin(np.arange(256), list(chars)) for chars in (
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!", b"?", b"#$%*&@^~", b"|", b".,;:", b"\n", b" \t", b"<>{}[]()=/\\_+", bytes(range(128, 256)),
))
CLASS_MATRIX = np.array(CLASSES, np.float64).T


def figures(text: bytes) -> np.ndarray:
    """Shape of one whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ CLASS_MATRIX / max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    top = max(seen.values(), default=0) / n
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x]
    letters = counts[65:91].sum() + counts[97:123].sum()
    rest = [
        len(seen) / n, np.log1p(len(seen)) / np.log1p(n) if words else 1.0, top, again,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words)), np.log1p(len(text) / n), np.log1p(len(lines)),
        counts[65:91].sum() / max(1, letters), np.log1p(max(map(len, words), default=0)),
    ]
    return np.concatenate([shares, np.sqrt(shares), rest])


N_FIGURES = 2 * len(CLASSES) + 10


@dataclass
class Model:
    """One hidden layer over standardised figures."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ w + b) @ v + c

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Minimise the non-negative risk by full-batch Adam. Where the negative part falls below zero, its gradient is turned round."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FIGURES), np.ones(N_FIGURES), [], prior)
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    rng = np.random.RandomState(seed)
    theta = [rng.randn(N_FIGURES, HIDDEN) / np.sqrt(N_FIGURES), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    x = np.clip((np.concatenate([positive, unlabelled]) - centre) / scale, -8, 8)
    n_p, n_u = len(positive), len(unlabelled)
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        w, b, v, c = theta
        h = np.tanh(x @ w + b)
        z = np.clip(h @ v + c, -30, 30)
        s = 1 / (1 + np.exp(-z))  # slope of log(1 + e^z), the loss of being called negative
        as_negative = np.logaddexp(0, z)
        negative_risk = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
        g = np.empty(len(z))
        sign = 1.0 if negative_risk >= 0 else -1.0
        g[:n_p] = (prior * (s[:n_p] - 1) * (negative_risk >= 0) - sign * prior * s[:n_p]) / n_p
        g[n_p:] = sign * s[n_p:] / n_u
        back = np.outer(g, v) * (1 - h * h)
        grads = [x.T @ back + PENALTY * w, back.sum(axis=0), h.T @ g + PENALTY * v, np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            theta[i] = theta[i] - RATE * (1 - step / (STEPS + 1)) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, theta, prior)


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labels outside of the held-out fold. A document with labels of both kinds isn't a trusted positive."""
    bounded_batches(docs.sparkSession)
    usable = fold(F.col("k")) != HELD_OUT_FOLD
    marked = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y is not null").filter(usable)
    marked = marked.groupBy("k").agg(F.min("y").alias("y"))
    prior, n = marked.agg(F.avg("y"), F.count("*")).first()
    if not n:
        return fit(np.zeros((0, N_FIGURES)), np.zeros((0, N_FIGURES)), DEFAULT_PRIOR)
    order = F.xxhash64("k", F.lit(1))
    trusted = marked.filter("y = 1").orderBy(order, "k").limit(sample_rows).select("k", F.lit(True).alias("trusted"))
    own = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    free = own.select("k").filter("k is not null").filter(usable).distinct().orderBy(F.xxhash64("k", F.lit(2)), "k").limit(sample_rows).select("k", F.lit(False).alias("trusted"))
    chosen = trusted.unionByName(free)  # at most 2 * sample_rows short rows
    rows = own.join(F.broadcast(chosen), "k")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for keys, flags, texts in split_columns(batch, ["k", "trusted", "t"]):
                x = [figures(t).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(flags), pa.array(x, pa.list_(pa.float64()))], names=["k", "trusted", "x"])

    got = rows.select("k", "trusted", "t").mapInArrow(run, "k long, trusted boolean, x array<double>").toArrow()
    keys, flags = got["k"].to_numpy(), got["trusted"].to_numpy(zero_copy_only=False).astype(bool)
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, N_FIGURES)
    turn = np.lexsort((*x.T[::-1], keys))
    x, flags = x[turn], flags[turn]
    return fit(x[flags], x[~flags], float(np.clip(prior, 0.01, 0.99)))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, key, score, predicted) of every whole text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), *([F.struct(*carry).alias("carry")] if carry else []))
    keep = [*["carry"] * bool(carry), "k"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for (texts,) in split_columns(batch, ["t"]):
                own = batch.slice(at, len(texts)).select(keep)
                at += SLICE_ROWS
                s = model.score(np.array([figures(t) for t in texts]).reshape(-1, N_FIGURES))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(s), pa.array(s >= PREDICT_FROM).cast(pa.int32())], names=[*keep, "score", "predicted"])

    out = rows.mapInArrow(run, rows.select(*keep).schema.add("score", "double").add("predicted", "integer"))
    return out.select(*[F.col(f"carry.`{c}`") for c in carry], *([] if key in carry else [F.col("k").alias(key)]), "score", "predicted")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
