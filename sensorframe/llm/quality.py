"""Quality by positive-unlabelled learning.

Only trusted positives (documents labelled good) and unlabelled web text are
learned from. A linear model minimises the non-negative unbiased risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss l and an estimated share of good documents as prior.
While the second term is below zero it adds nothing, so that the fit cannot
gain by pushing unlabelled texts below the share the prior leaves them. The
weights of the later steps are averaged, and the bias is set so that the mean
score of the unlabelled texts equals the prior. Every whole text is then scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, id_crc, mix64
from .linear import Adam, back, one_text_each, sample_by_hash, score_rows, sigmoid

#: Hashed features: shares of characters and of pairs of them, and a few ratios of the whole text.
NGRAMS, BITS, RATIOS = (1, 2), 12, 10
SIZE = (1 << BITS) + RATIOS
#: Rows that the model is fitted on, at most: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 4_000, 8_000
THRESHOLD = 0.3
PIECE = 1 << 20


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text; an empty text has only its constant ratios."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(points), PIECE):
        p = points[at:at + PIECE + 2].astype(np.uint64)
        for n in NGRAMS:
            size = min(len(p) - n + 1, PIECE)
            if size > 0:
                h = np.full(size, n, np.uint64)
                for j in range(n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + p[j:j + size]
                counts += np.bincount((mix64(h) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    v = np.sqrt(counts[at])
    v /= max(np.sqrt((v * v).sum()), 1e-9)
    words, lines = text.split(), text.split("\n")
    n, m = max(len(words), 1), max(len(points), 1)
    letters = max(sum(map(str.isalpha, words)), 1) / n
    upper = sum(map(str.isupper, words)) / n
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    distinct = len(set(words)) / n
    ratios = np.array([
        letters, upper, repeats, distinct, float(distinct < 0.1),
        len(set(lines)) / len(lines), min(m / n, 30.0) / 30.0, np.log1p(n) / 12.0,
        float(sum(map(str.isalnum, words))) / n, np.count_nonzero((points < 65) & (points > 32)) / m])
    return np.concatenate([at, np.arange(1 << BITS, SIZE)]), np.concatenate([v * 3.0, ratios * 2.0])


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        i, v = features(text)
        return float(sigmoid(self.bias + self.weight[i] @ v))


def fit_nnpu(pos, unl, prior: float, size: int, decay: float = 1e-4, rate: float = 0.2, steps: int = 150):
    """(weights, bias) minimising the non-negative risk over sparse rows
    ``pos`` and ``unl``, each (indices, values, bounds), neither empty."""
    w, b, opt, mean = np.zeros(size), 0.0, Adam(size + 1, rate), np.zeros(size + 1)
    n_pos, n_unl = len(pos[2]) - 1, len(unl[2]) - 1
    for step in range(steps):
        sp, su = score_rows(w, b, *pos), score_rows(w, b, *unl)
        # loss l(g) = log(1 + exp(-g)): l'(g) = -sigmoid(-g); as a negative, l(-g): derivative sigmoid(g)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        up_pos, up_unl = -prior * sigmoid(sp) / n_pos, sigmoid(su) / n_unl
        gp, gu = -prior * sigmoid(-sp) / n_pos, np.zeros(n_unl)
        if negative > 0:
            gp, gu = gp + up_pos, up_unl
        g = back(gp, *pos, size) + back(gu, *unl, size) + decay * w
        d = opt.step(np.append(g, gp.sum() + gu.sum()))
        w, b = w - d[:-1], b - d[-1]
        if step >= steps // 2:
            mean += np.append(w, b) / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def bias_for_mean(scores: np.ndarray, mean: float) -> float:
    """What to add to ``scores`` so that their sigmoids average ``mean``."""
    low, high = -scores.max() - 20.0, -scores.min() + 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if sigmoid(scores + mid).mean() > mean else (mid, high)
    return float((low + high) / 2)


def _rows(docs: DataFrame, ids: DataFrame):
    """Features of the documents ``ids`` (a bounded sample), by doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["kind", "i", "v"])

    texts = one_text_each(docs, ids).select("kind", "text")
    out: dict[int, list] = {0: [], 1: []}
    for r in texts.mapInArrow(run, "kind int, i binary, v binary").toLocalIterator():
        out[r["kind"]].append((bytes(r["i"]), bytes(r["v"])))
    packed = {}
    for kind, rows in out.items():
        rows.sort()  # the order of arrival must not matter
        ptr = np.concatenate([[0], np.cumsum([len(i) // 4 for i, _ in rows])]).astype(np.int64)
        packed[kind] = (np.frombuffer(b"".join(i for i, _ in rows), np.int32).astype(np.int64),
                        np.frombuffer(b"".join(v for _, v in rows), np.float32).astype(np.float64), ptr)
    return packed


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        ids: DataFrame | None = None) -> Model:
    """Model from at most ``positives`` documents labelled good in ``labels``
    (doc_id, quality) and at most ``unlabelled`` documents of ``ids`` (all
    documents by default), taken without their labels.

    The prior is the share of good rows among all of ``labels``. Labels that
    are null or not 0/1 and ids that are null are left out; of documents that repeat an id the
    first text in order is learned. Without good
    texts or without unlabelled ones every text scores the prior (0.5
    without labels).
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    share = known.agg(F.avg("q")).first()[0]
    prior = min(max(0.5 if share is None else float(share), 0.01), 0.99)
    flat = Model(np.zeros(SIZE), float(np.log(prior / (1 - prior))))
    good = sample_by_hash(known.filter("q = 1").select("doc_id"), positives, 11).withColumn("kind", F.lit(1))
    pool = (docs if ids is None else ids).filter("doc_id IS NOT NULL").select("doc_id").distinct()
    web = sample_by_hash(pool, unlabelled, 13).withColumn("kind", F.lit(0))
    rows = _rows(docs, good.unionByName(web))
    if len(rows[1][2]) < 2 or len(rows[0][2]) < 2:
        return flat
    w, b = fit_nnpu(rows[1], rows[0], prior, SIZE)
    return Model(w, b + bias_for_mean(score_rows(w, b, *rows[0]), prior))


def training_side(frame: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return frame.filter(id_crc(F.col("doc_id")) % 5 != 0)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; only
    the text is looked at; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            s = np.array([m.score(t.as_py()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    texts = doc_texts(docs)
    out = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
