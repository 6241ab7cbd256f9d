"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a number of words by weight. Whole passes over the source
come first; the rest of its budget is filled from the counts of its documents
by exact length: first the same share of every length, then single lengths
while the rest is large, then a bounded-knapsack dynamic programme over the
lengths left for what remains. Only counts by (source, length) enter that
computation. Documents are then chosen by a seeded order within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most passes over a document.
SHARE, PASSES = 1.5, 2
#: Largest rest, in words, that the dynamic programme fits.
KNAPSACK = 1 << 17
#: Buckets of the seeded order within one length of one source.
ORDER_BUCKETS = 1 << 12


def word_count(text):
    """Number of maximal runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size) -> plus target: ``share`` of all words dealt by
    weight, no source above ``passes`` times its size, the excess reshared by
    weight until none is above. In closed form: sources sorted by the level
    (cap / weight) at which they fill up; the common level is the first at which
    the words left suffice. One row per source, so the global order is small."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
                           % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * passes
    t = sizes.withColumn("w", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("w"))
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = (t.withColumn("all_words", F.sum("source_size").over(whole).cast("double") * share)
         .withColumn("all_w", F.sum("w").over(whole))
         .withColumn("left", F.col("all_words") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
         .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
         .withColumn("fits", F.col("level") * F.col("left_w") <= F.col("left")))
    t = t.withColumn("nth", F.row_number().over(by_level))
    common = F.min(F.when(~F.col("fits"), F.struct("nth", (F.col("left") / F.col("left_w")).alias("l")))).over(whole)
    return t.withColumn("at", common["l"]).select(
        "source", "source_size",
        F.when(F.col("at").isNull() | F.col("fits"), F.col("cap"))
        .otherwise(F.least("cap", F.col("w") * F.col("at"))).alias("target"))


def fit_counts(length: np.ndarray, count: np.ndarray, budget: int, limit: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take (at most ``count``) so that
    their words come as near below ``budget`` as found; exact when the subset-sum
    programme reaches the rest. Documents longer than ``limit`` are taken by the
    same programme in cells of several words."""
    take = np.zeros(len(length), np.int64)
    total = int((length * count).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return count.astype(np.int64)
    take = np.floor(count * (budget / total)).astype(np.int64)
    rest = budget - int((take * length).sum())
    if rest < 0:  # rounding of the share
        take, rest = np.zeros(len(length), np.int64), budget
    # With long documents also from a larger rest, which holds some of the longest; the nearer fit counts.
    windows = sorted({limit, max(limit, 4 * int(length[take < count].max()))})
    fits = [_fill(length, count, take, rest, limit, window) for window in windows]
    return max(fits, key=lambda t: int((t * length).sum()))


def _fill(length: np.ndarray, count: np.ndarray, take: np.ndarray, rest: int, limit: int, window: int) -> np.ndarray:
    """``take`` with ``rest`` words more, or nearly."""
    take = take.copy()
    # Longest lengths first, until the rest is within the window.
    for j in np.argsort(-length, kind="stable"):
        if rest <= window:
            break
        if length[j]:
            more = min(int(count[j] - take[j]), (rest - window) // int(length[j]) + (int(length[j]) <= window))
            if more > 0:
                take[j] += more
                rest -= more * int(length[j])
    while rest > 0:
        more = _programme(length, count - take, rest, limit)
        gained = int((more * length).sum())
        take += more
        if rest <= limit or not gained:
            break
        rest -= gained
    return take


def _programme(length: np.ndarray, free: np.ndarray, rest: int, limit: int) -> np.ndarray:
    """Counts of each length, at most ``free``, whose words come near below
    ``rest``: bounded knapsack by binary splitting. Up to ``limit`` every sum
    is held; beyond it one sum in each of ``limit`` equal cells, longest lengths
    first, so that short ones are left for what remains."""
    unit = -(-rest // limit)
    items = []
    for j in range(len(length)) if unit == 1 else np.argsort(-length, kind="stable"):
        left, size, part = int(free[j]), int(length[j]), 1
        while left > 0 and size and part * size <= rest:
            n = min(part, left)
            items.append((n * size, j, n))
            left -= n
            part *= 2
    # The sum that each cell holds, and the item by which it was first reached.
    held = np.full(rest // unit + 1, -1, np.int64)
    via = np.full(rest // unit + 1, -1, np.int64)
    held[0] = 0
    for k, (size, _, _) in enumerate(items):
        sums = held[held >= 0] + size
        sums = sums[sums <= rest]
        sums = sums[held[sums // unit] < 0]
        held[sums // unit] = sums
        via[sums // unit] = k
        if held[-1] == rest:
            break
    take = np.zeros(len(length), np.int64)
    s = int(held.max())
    while s:
        size, j, n = items[via[s // unit]]
        take[j] += n
        s -= size
    return take


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, size, source_size, target,
    taken); taken is the number of words the mix takes of the document,
    0 to ``passes`` times its size. Reruns with the same seed agree.

    A null source is a source of its own and comes last; null and empty texts
    have no words and are never taken. Ties of the seeded order fall to the
    smaller doc_id; whole repeats of a row are chosen one after another.
    """
    base = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
                 .withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
                 .withColumn("part", F.pmod("key", F.lit(ORDER_BUCKETS)).cast("int")), "mix-sizes")
    by_length = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = saved(targets(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                         weights, share, passes), "mix-targets")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        total = int(frame["source_size"].iloc[0])
        target = int(round(frame["target"].iloc[0]))
        full = min(passes, target // total) if total else 0
        f = frame.sort_values("size")
        more = fit_counts(f["size"].to_numpy(np.int64), f["n"].to_numpy(np.int64), target - full * total)
        return pd.DataFrame({"source": f["source"], "size": f["size"], "full": full, "more": more})

    matched = by_length.join(goal, by_length["source"].eqNullSafe(goal["source"])).select(
        by_length["source"], "size", "n", "source_size", "target")
    plan = matched.groupBy("source").applyInPandas(fit, "source string, size long, full long, more long")
    # The first `more` documents of a length in seeded order: whole buckets by their counts, the last one by rank.
    cells = base.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("cell"))
    before = F.coalesce(F.sum("cell").over(W.partitionBy("source", "size").orderBy("part")
                                           .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).alias("c").join(
        plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size"))).select(
        F.col("c.source").alias("s"), F.col("c.size").alias("z"), F.col("part").alias("q"), "before", "full", "more")
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("key", "doc_id"))
    out = base.withColumn("rank", rank).join(
        cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("q")))
    out = out.select("doc_id", "source", "size",
                     (F.col("size") * (F.col("full") + (F.col("before") + F.col("rank") <= F.col("more")).cast("long"))
                      ).alias("taken")).alias("o")
    return out.join(goal.alias("g"),
                    F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        "doc_id", F.col("o.source").alias("source"), "size", "source_size", "target", "taken")
