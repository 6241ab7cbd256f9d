"""Sparse rows and a logistic fit in numpy, for models of bounded size."""

from __future__ import annotations

import numpy as np


def score_rows(w: np.ndarray, b: float, ind: np.ndarray, val: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """b + <w, row> for rows stored one after another (ptr: row bounds)."""
    sums = np.concatenate([[0.0], np.cumsum(val * w[ind])])
    return b + sums[ptr[1:]] - sums[ptr[:-1]]


def back(g: np.ndarray, ind: np.ndarray, val: np.ndarray, ptr: np.ndarray, size: int) -> np.ndarray:
    """Gradient of the weights from the gradient of each row's score."""
    return np.bincount(ind, weights=val * np.repeat(g, np.diff(ptr)), minlength=size)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def sample_by_hash(ids, n: int, seed: int):
    """At most ``n`` rows of ``ids`` (doc_id, ...) in a seeded order of their ids."""
    from pyspark.sql import functions as F
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def one_text_each(docs, chosen):
    """(text, other columns of ``chosen``): one text for every id of ``chosen`` (doc_id, ..., a
    bounded table without repeats), the first in order where rows repeat the id. A
    partial aggregate picks it, so rows that share one id do not meet in a task."""
    from pyspark.sql import functions as F

    from .common import doc_texts
    other = [c for c in chosen.columns if c != "doc_id"]
    first = doc_texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return first.join(F.broadcast(chosen), "doc_id").select("text", *other)
