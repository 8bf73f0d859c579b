"""Language identification by averaged hashed subword embeddings.

A text's vector is the mean of the embeddings of its hashed letter 1-, 2- and
3-grams (words are delimited by one mark, case is folded); a linear softmax
reads the language off it. Both layers are trained together by stochastic
gradient descent in numpy. A temperature fitted on held-back sample rows makes
the scores probabilities, and the rejection threshold is a low quantile of the
held-back rows' scores. At scoring, the two linear layers fold into one table
of per-gram logits, so a text costs one look-up per gram.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_arrow, portions

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
DIM = 16
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram, texts one after another, and each text's number of grams."""
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letter_table()[points]
    keep = letter | np.concatenate([[True], letter[:-1]])  # one mark between words
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])[keep]
    code = np.where(letter, points, np.uint32(0))[keep]
    found, whose = [], []
    for order in ORDERS:
        n = len(code) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, dtype=np.uint32)
        for k in range(order):
            key = (key ^ code[k : k + n]) * np.uint32(0x85EBCA6B)
            key ^= key >> np.uint32(15)
        some = (owner[:n] == owner[order - 1 :]) & ((code[:n] != 0) if order == 1 else True)
        if order == 2:
            some &= (code[:n] != 0) | (code[1:] != 0)
        found.append((key % np.uint32(BUCKETS))[some].astype(np.int64))
        whose.append(owner[:n][some])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(found)[order], np.bincount(whose, minlength=len(texts))


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: logits of each gram at temperature 1
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each label, and whether there was a letter."""
        ids, counts = grams(texts)
        letters = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        logits = np.zeros((len(texts), len(self.labels)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            for k in range(len(self.labels)):
                logits[some, k] = np.add.reduceat(self.table[:, k][ids], starts, dtype=np.float64) / counts[some]
        return _softmax(logits / self.temperature), letters


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=-1, keepdims=True)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of one whole text's grams, and how often each occurs."""
    return np.unique(grams([text])[0], return_counts=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 8, rate: float = 0.5, keep: float = 0.999, seed: int = 7) -> LanguageModel:
    """Fit on the given rows' ``gram_counts``; every fifth row is held back for calibration (if there are ten at least).

    The temperature minimises their log loss; the threshold is the score that a
    share ``keep`` of them reaches, but no more than 0.5.
    """
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    y = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(labels)))
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 else np.zeros(len(rows), dtype=bool)
    own = np.flatnonzero(~held)
    steps, step = max(1, epochs * len(own)), 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            at, count = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            share = count / count.sum()
            vec = share @ emb[at]
            err = _softmax(vec @ out)
            err[y[i]] -= 1
            back = out @ err
            out -= lr * np.outer(vec, err)
            emb[at] -= lr * 8 * np.outer(share, back)
    model = LanguageModel(labels, emb @ out)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    logits = np.array([(rows[i][1] / max(1, rows[i][1].sum())) @ model.table[rows[i][0]] for i in check])
    loss = lambda t: -np.log(np.clip(_softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12, 1)).mean()
    model.temperature = float(min(2.0 ** np.arange(-4, 4.25, 0.25), key=loss))
    best = _softmax(logits / model.temperature).max(axis=1)
    model.threshold = float(min(0.5, np.quantile(best, 1 - keep)))
    model.table = model.table.astype(np.float32)
    return model


def _packed(drawn: DataFrame) -> DataFrame:
    """Drawn rows with their texts' gram counts, packed, in place of the texts: ``BUCKETS`` entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 0):
                found = [gram_counts(t) for t in batch.column(0).to_pylist()]
                packed = [pa.array([x[k].astype(np.int32).tobytes() for x in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *packed], ["lang", "_draw", "buckets", "counts"])

    return map_arrow(drawn.select("text", "lang", "_draw"), run, "lang string, _draw long, buckets binary, counts binary")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", sample: int = 2000) -> LanguageModel:
    """Train on at most ``sample`` labelled rows, chosen by a hash of ``order_col``, each with its whole text.

    Only this training sample is bounded. What reaches the driver of a row are
    its gram counts, whatever the text's length. Rows with null text or label
    are left out.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(order_col).alias("id"))
    got = bounded_sample(rows, "id", sample, _packed)
    return train([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns plus ``lang_pred``, ``score`` (its probability) and ``accepted``.

    Null texts and texts without a letter, and all texts if nothing was learned,
    get ``und`` with score 0 and are not accepted; others are accepted if the
    score reaches the model's threshold. Columns of these names are replaced.
    """
    new = ["lang_pred", "score", "accepted"]
    keep = [c for c in docs.columns if c not in new]
    at = keep.index(text_col)
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for whole in batches:
            for batch in portions(whole, at, 1 << 18):
                p, letters = m.probabilities([t or "" for t in batch.column(at).to_pylist()])
                sure = letters if m.labels else np.zeros(len(letters), dtype=bool)
                best = p.argmax(axis=1) if m.labels else np.zeros(len(letters), dtype=int)
                score = np.where(sure, p.max(axis=1), 0.0) if m.labels else np.zeros(len(letters))
                name = [m.labels[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array(sure & (score >= m.threshold))], [*keep, *new])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)
    return docs.select(*[f"`{c}`" for c in keep]).transform(map_arrow, run, f"{schema}, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
