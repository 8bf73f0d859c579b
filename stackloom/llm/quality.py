"""Quality scores from a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Boosting goes round the
features again and again; each turn fits a shallow tree to one feature's bins
and adds its leaves to that feature's look-up table. Then the pairs that still
explain most are boosted the same way on coarse two-dimensional tables. A
score is a sum of table entries, looked up for many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_arrow, stored, utf8

FEATURES = ["log_bytes", "lower", "upper", "digit", "blank", "newline", "stop", "symbol", "high", "word_len", "long_words", "short_words", "distinct_words", "echo", "top_word", "distinct_lines", "line_len", "marked"]
BINS, COARSE = 32, 8

_kind = np.full(256, 7, dtype=np.int64)
_kind[97:123], _kind[65:91], _kind[48:58], _kind[32], _kind[10], _kind[128:] = 0, 1, 2, 3, 4, 8
_kind[[ord(c) for c in ".,;:'-?"]] = 6


def features(text: bytes) -> list[float]:
    """Shares and lengths that describe one text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(np.log1p(n)), *[0.0] * (len(FEATURES) - 1)]
    kinds = np.bincount(_kind[np.frombuffer(text, dtype=np.uint8)], minlength=9) / n
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    _, counts = np.unique(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)), return_counts=True)
    lines = text.split(b"\n")
    m = len(words)
    echo = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(not 48 <= w[-1] <= 122 and w[-1] not in b".,;:'-?" and w[-1] < 128 for w in words)
    return [
        float(np.log1p(n)), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[6], kinds[7], kinds[8],
        float(sizes.mean()), float((sizes > 12).mean()), float((sizes <= 3).mean()),
        len(counts) / m, echo / m, float(counts.max()) / m, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), marked / m,
    ]


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<float>)`` of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in utf8(batch.column(1))], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_arrow, run, "doc_id long, x array<float>")


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray]  # by feature: inner bin edges
    single: np.ndarray  # features x BINS
    pairs: list[tuple[int, int]]
    double: np.ndarray  # pairs x COARSE x COARSE

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = self.base + self.single[np.arange(len(self.cuts)), b].sum(axis=1)
        for k, (i, j) in enumerate(self.pairs):
            z += self.double[k, _coarse(b[:, i]), _coarse(b[:, j])]
        return 1 / (1 + np.exp(-z))


def _coarse(b: np.ndarray) -> np.ndarray:
    return b * COARSE // BINS


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree of that depth on binned sums."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > _gain(g.sum(), h.sum()) + 1e-6:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best single cut in each direction on two-dimensional sums: leaf table and gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quad = lambda c: [c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]]
    qg, qh = quad(cg), quad(ch)
    gain = sum(_gain(a, b) for a, b in zip(qg, qh, strict=True))
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [_leaf(a[r, c], b[r, c]) for a, b in zip(qg, qh, strict=True)]
    table = np.empty_like(g)
    table[: r + 1, : c + 1], table[: r + 1, c + 1 :], table[r + 1 :, : c + 1], table[r + 1 :, c + 1 :] = v
    return table, float(gain[r, c] - _gain(cg[-1, -1], ch[-1, -1]))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1) -> AdditiveModel:
    """Fit to rows ``x`` with labels ``y`` of 0 and 1; without rows the score is 0.5 everywhere."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    x = x.reshape(-1, k)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(k)]
    model = AdditiveModel(float(np.log(prior / (1 - prior))), cuts, np.zeros((k, BINS)), [], np.zeros((0, COARSE, COARSE)))
    if not len(x):
        return model
    b, z = model.bins(x), np.full(len(x), model.base)
    p = lambda: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        for j in range(k):
            q = p()
            step = rate * _tree(np.bincount(b[:, j], y - q, BINS), np.bincount(b[:, j], q * (1 - q), BINS))
            model.single[j] += step
            z += step[b[:, j]]
    cell = {(i, j): _coarse(b[:, i]) * COARSE + _coarse(b[:, j]) for i, j in combinations(range(k), 2)}
    sums = lambda at, v: np.bincount(at, v, COARSE * COARSE).reshape(COARSE, COARSE)
    q = p()
    gains = {ij: _cross(sums(at, y - q), sums(at, q * (1 - q)))[1] for ij, at in cell.items()}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:n_pairs]
    model.double = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for m, ij in enumerate(model.pairs):
            q, at = p(), cell[ij]
            step = rate * _cross(sums(at, y - q), sums(at, q * (1 - q)))[0]
            model.double[m] += step
            z += step.ravel()[at]
    return model


def fit(rows: DataFrame, label_col: str = "quality", order_col: str = "doc_id", sample: int = 20_000) -> AdditiveModel:
    """Train on at most ``sample`` rows of ``(x, label)``, chosen by a hash of ``order_col``; null labels are left out."""
    rows = rows.where(F.col(label_col).isNotNull()).select("x", F.col(label_col).cast("double").alias("y"), F.col(order_col).alias("id"))
    got = bounded_sample(rows, "id", sample)
    return train(np.array([r.x for r in got], dtype=np.float32), np.array([r.y for r in got], dtype=np.float64))


def score(feats: DataFrame, model: AdditiveModel) -> DataFrame:
    """``(doc_id, score)`` for rows of ``text_features``: the probability of label 1."""
    known = feats.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known.value.score(x) if batch.num_rows else [], pa.float64())], ["doc_id", "score"])

    return feats.select("doc_id", "x").transform(map_arrow, run, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = stored(text_features(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(fold("doc_id", 4) != 2)
    model = fit(feats.join(labels, "doc_id"))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return score(feats, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
