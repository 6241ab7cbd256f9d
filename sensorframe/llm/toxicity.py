"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes
log-count ratios.

From a bounded sample of labelled rows come, for every hashed character
n-gram, the shares of toxic and of other texts that hold it. The log of their
ratio scales the n-gram's presence in a text, and a logistic classifier is
fitted on the scaled features. Every whole text of the corpus is then scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import id_crc, mix64, saved
from .linear import Adam, back, one_text_each, sample_by_hash, score_rows, sigmoid

#: Lengths of the n-grams and hashed feature space.
NGRAMS, BITS = (3, 4, 5, 6), 20
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_000
#: n-grams whose log-count ratio is nearer to zero than this carry no weight.
MIN_RATIO = 1.0
THRESHOLD = 0.3
#: Characters hashed at a time; bounds memory on very long texts.
PIECE = 1 << 20


def ngrams(text: str, lengths=NGRAMS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed character n-grams of the lower-cased text, in pieces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    top = max(lengths)
    for at in range(0, max(len(points), 1), PIECE):
        part = points[at:at + PIECE + top - 1]
        for n in lengths:
            size = len(part) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + part[j:j + size]
            yield (mix64(h) >> np.uint64(64 - bits)).astype(np.int64)


def present(text: str, weight: np.ndarray | None = None) -> np.ndarray:
    """Distinct n-grams of a text; with ``weight`` only those it is not zero for."""
    parts = [np.unique(h if weight is None else h[weight[h] != 0]) for h in ngrams(text)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


@dataclass
class Model:
    weight: np.ndarray  # ratio times fitted weight, by feature
    bias: float

    def score(self, text: str) -> float:
        w = self.weight
        f = present(text, w)
        return float(sigmoid(self.bias + w[f].sum(dtype=np.float64)))


def fit_logistic(rows, y: np.ndarray, size: int, decay: float = 1e-3, rate: float = 0.05, steps: int = 300):
    """Weights (size) and bias of an L2-regularised logistic fit, full batches."""
    ind, val, ptr = rows
    w, b = np.zeros(size), 0.0
    if not len(y):
        return w, b
    opt = Adam(size + 1, rate)
    for _ in range(steps):
        g = (sigmoid(score_rows(w, b, ind, val, ptr)) - y) / len(y)
        d = opt.step(np.append(back(g, ind, val, ptr, size) + decay * w, g.sum()))
        w, b = w - d[:-1], b - d[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_ratio: float = MIN_RATIO) -> Model:
    """Model from at most ``sample`` labelled rows (doc_id, toxic) of ``labels``.

    Labels that are null or not 0/1 and rows without doc_id are left out; a doc_id
    labelled twice counts as toxic if one row says so, and of documents that repeat an
    id the first text in order is learned. Without labelled texts
    of both classes the model scores every text with the share of toxic rows
    (0 without labels).
    """
    spark = docs.sparkSession
    ids = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = sample_by_hash(ids, sample, 5)  # at most `sample` ids: safe to broadcast
    rows = saved(one_text_each(docs, chosen), "toxic-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y][present(text.as_py())] += 1
        f = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(seen[1][f]), pa.array(seen[0][f])],
                                         names=["f", "pos", "neg"])

    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    ratio = np.zeros(1 << BITS, np.float32)
    if not pos or not neg:
        share = (pos + 0.0) / max(pos + neg, 1)
        return Model(ratio, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # log((share of toxic texts with f) / (share of others with f)), one added to the counts.
    logs = (rows.mapInArrow(counts, "f int, pos int, neg int").groupBy("f")
            .agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
            .select("f", (F.log((F.col("p") + 1) / (pos + 2)) - F.log((F.col("n") + 1) / (neg + 2))).alias("r"), "p", "n")
            .filter((F.abs("r") >= min_ratio) & (F.col("p") + F.col("n") >= 3)))
    for r in logs.select("f", "r").toLocalIterator():  # at most 2^BITS rows
        ratio[r[0]] = r[1]
    shared = spark.sparkContext.broadcast(ratio)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                pa.array([np.asarray(present(t.as_py(), shared.value), np.int32).tobytes() for t in b.column(0)], pa.binary()),
                b.column(1)], names=["f", "y"])

    got = sorted((bytes(r["f"]), r["y"]) for r in rows.mapInArrow(features, "f binary, y int").toLocalIterator())  # at most `sample` rows
    flat = np.frombuffer(b"".join(f for f, _ in got), np.int32)
    used = np.unique(flat).astype(np.int64)
    packed = (np.searchsorted(used, flat), ratio[flat].astype(np.float64) / 4,
              np.concatenate([[0], np.cumsum([len(f) // 4 for f, _ in got])]).astype(np.int64))
    w, b = fit_logistic(packed, np.array([y for _, y in got], np.float64), len(used))
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = w * ratio[used] / 4
    return Model(weight, float(b))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned: crc32(doc_id as text) mod 4 is not 2."""
    return labels.filter(id_crc(F.col("doc_id")) % 4 != 2).select("doc_id", "toxic")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a last column ``__toxic_score``; only the text
    is looked at. Null and empty texts get the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            s = np.array([m.score(t.as_py() or "") for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "__toxic_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__toxic_score", DoubleType())]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    s = with_scores(docs.select("doc_id", "text"), model)
    return s.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"),
                    F.col("__toxic_score").alias("score"),
                    (F.col("__toxic_score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that score under the threshold."""
    return with_scores(docs, model).filter(F.col("__toxic_score") < threshold).drop("__toxic_score")
