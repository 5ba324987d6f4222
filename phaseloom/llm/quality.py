"""Quality by a vote of nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.llm.common import crc_bucket
from phaseloom.llm.textscan import Words, text_slices

FEATURES = 2048
#: A repeated word counts as so many pairs of bytes.
REPEATS = 4


def features(texts: list[bytes]) -> np.ndarray:
    """Hashed counts of the pairs of neighbouring bytes of each text, and in slot 0 of words that repeat the word before them.

    Counts are damped by a root and scaled to length 1 (zero for empty texts)."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    limits = np.cumsum([len(t) + 1 for t in texts])
    pair = (raw[:-1].astype(np.uint32) << np.uint32(8)) | raw[1:]
    slot = (pair * np.uint32(2654435761)) >> np.uint32(21)
    lengths = np.diff(limits, prepend=0)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    keep = np.ones(len(text), bool)
    keep[limits - 1] = False  # pairs that begin between two texts
    keep &= raw[1 : len(text) + 1] != 0
    out = np.bincount(text[keep] * FEATURES + np.maximum(slot[: len(text)][keep], 1), minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)
    words = Words(texts)
    own = words.hashes()
    which = np.repeat(np.arange(len(texts)), words.counts)
    again = which[1:][(own[1:] == own[:-1]) & (which[1:] == which[:-1])]
    out[:, 0] = REPEATS * np.bincount(again, minlength=len(texts))
    out = np.sqrt(out.astype(np.float32))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]


@dataclass(frozen=True)
class Model:
    """Weights of features, their projection to the latent space, and the labelled documents there."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        out = (x * self.weights) @ self.projection
        return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        """Mean label of the nearest labelled documents, weighted by a power of their cosine, drawn to the prior by one vote."""
        out = np.empty(len(texts))
        for low in range(0, len(texts), block):
            near = self.latent(features(texts[low : low + block])) @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, at, 1), 0.0).astype(np.float64) ** self.power
            out[low : low + block] = ((weight * self.labels[at]).sum(axis=1) + self.prior) / (weight.sum(axis=1) + 1)
        return out


def _leading(x: np.ndarray, dims: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of a matrix, by a few rounds of subspace iteration from a fixed start."""
    base = np.random.default_rng(0).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        base = np.linalg.qr(x.T @ (x @ base))[0]
    small = x @ base
    turn = np.linalg.eigh(small.T @ small)[1][:, ::-1][:, :dims]
    return (base @ turn).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 6000, dims: int = 64, neighbours: int = 25, power: float = 8.0) -> Model | None:
    """A model of at most `most_rows` labelled rows, the first by a hash of their id; None if there are none.

    Texts become hashed byte-pair counts on the executors, weighted by inverse document frequency and projected to the leading
    right singular vectors of the sample. The sample's vectors are small and bounded: most_rows times dims numbers are broadcast.
    """
    known = labels.filter((F.lit(True) if allowed is None else allowed) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("k"), "k").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1)):
                rows = features(texts).astype(np.float16)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "row"])

    rows = texts.select("label", "text").mapInArrow(run, "label int, row binary").toPandas()
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["row"]), np.float16).reshape(len(rows), FEATURES).astype(np.float32)
    y = rows["label"].to_numpy(np.float64)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = x * weights
    projection = _leading(x, dims)
    model = Model(weights, projection, np.zeros((0, dims), np.float32), y, float(y.mean()), neighbours, power)
    latent = x @ projection
    latent /= np.maximum(np.sqrt((latent * latent).sum(axis=1)), 1e-12)[:, None]
    return Model(model.weights, projection, latent, y, model.prior, neighbours, power)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; without a model every score is 0.5.

    Null and empty texts have no direction: their score is the prior. Rows that share an id are scored each; an empty table gives
    no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1)):
                p = own.scores(texts) if own else np.full(j - i, 0.5)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double")


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(crc_bucket(key, 5) == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document, by a vote of labelled documents that are not held out."""
    model = fit(docs, labels, "quality", ~held_out(F.col(id_col)), id_col, text_col)
    rows = score(docs, model, id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
