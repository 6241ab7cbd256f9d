"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared runs of words (seeds).
For every pair that shares one, the longest common runs that do not overlap are
marked again and again, found by running Karp-Rabin hashes, until no run of
``SEED`` words is left. The share of the item's words in marked runs decides:
passages that were reordered or split still cover the item.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, drop_rows, list_column, numbered, row_texts, saved, shingle_hashes

#: Words of a seed, which is also the shortest run that is marked.
SEED = 5
#: Share of an item's words that must be covered.
COVERAGE = 0.5
#: Bits of the filter that tells which seeds can be a benchmark's; fixed, whatever the benchmark's size.
FILTER_BITS = 1 << 23
WORD = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(item: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every run of ``s`` unmarked words."""
    top, h, run = pow(_BASE, s - 1, _MOD), 0, 0
    for j, t in enumerate(item):
        if not free[j]:
            h, run = 0, 0
            continue
        if run == s:
            h = (h - item[j - s] * top) % _MOD
            run -= 1
        h = (h * _BASE + t) % _MOD
        run += 1
        if run == s:
            yield j - s + 1, h


def tile(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, item start, document start) of a greedy tiling. Zero is
    a barrier that matches nothing. Ties fall to the earlier item position,
    then the earlier document position."""
    free_i, free_d = [t != 0 for t in item], [t != 0 for t in doc]
    tiles, s = [], max(least, len(item))
    while True:
        found, at = [], defaultdict(list)
        for i, h in _grams(item, free_i, s):
            at[h].append(i)
        if at:
            for d, h in _grams(doc, free_d, s):
                for i in at.get(h, ()):
                    if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                        continue  # part of a longer run that began before
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                        n += 1
                    if n >= s:
                        found.append((n, i, d))
        marked = False
        for n, i, d in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(free_i[i:i + n]) and all(free_d[d:d + n]):
                free_i[i:i + n], free_d[d:d + n] = [False] * n, [False] * n
                tiles.append((n, i, d))
                marked = True
        if marked:
            continue  # what was hidden by a longer run may still hold a run of s words
        if s <= least:
            return tiles
        s = max(least, s // 2)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nr, item_id, text) -> (nr, item_id, words)."""
    ids = WordIds()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_column(
            [ids.of(words_of(t.as_py())).view(np.int64) for t in b.column(2)], pa.int64())], names=["nr", "item_id", "words"])


def _seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [np.asarray(x.as_py(), np.int64).view(np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(
                [np.unique(shingle_hashes(x, k)).view(np.int64) for x in w], pa.int64())], names=["nr", "seeds"])
    return run


def _matches(bits, k: int):
    """(row, doc_id, text) -> (row, doc_id, words, seeds) of the texts with a seed in the
    filter: the words that such seeds cover, parted by zeros, and the seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = WordIds(), bits.value
        mask = np.uint64(FILTER_BITS - 1)
        for b in batches:
            rows, words, seeds = [], [], []
            for n, text in enumerate(b.column(2)):
                w = ids.of(words_of(text.as_py()))
                h = shingle_hashes(w, k)
                slot = (h & mask).astype(np.int64)
                hit = np.flatnonzero((held[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                if not len(hit):
                    continue
                covered = np.zeros(len(w) + 1, np.int32)
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + k, -1)
                inside = np.cumsum(covered[:-1]) > 0
                # a zero word after every covered stretch
                ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
                kept = np.insert(np.where(inside, w, np.uint64(0)), ends, np.uint64(0))
                flag = np.insert(inside, ends, True)
                rows.append(n)
                words.append(kept[flag].view(np.int64))
                seeds.append(np.unique(h[hit]).view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), list_column(words, pa.int64()),
                    list_column(seeds, pa.int64())], names=["row", "doc_id", "words", "seeds"])
    return run


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, covered, tiles = [], [], []
            for item, doc in zip(b.column(3), b.column(4), strict=True):
                i, got = item.as_py(), []
                got = tile(i, doc.as_py(), k)
                size.append(len(i))
                covered.append(sum(n for n, _, _ in got))
                tiles.append(len(got))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(size, pa.int32()), pa.array(
                covered, pa.int32()), pa.array(tiles, pa.int32())], names=["row", "doc_id", "item_id", "item_words", "covered", "tiles"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered, tiles, coverage) of the pairs
    whose tiles cover at least ``coverage`` of the item's words.

    Words are runs of letters, digits and underscores in lower case. Items of
    fewer than ``seed`` words and null or empty texts match nothing. Rows that
    repeat a doc_id give one result, the best of them; the same holds for item_id.
    A null doc_id or item_id counts as one id of its own.
    """
    best = F.max(F.struct("coverage", "covered", "item_words", "tiles")).alias("m")
    return _found(docs, benchmark, seed, coverage).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.item_words", "m.covered", "m.tiles", "m.coverage")


def _found(docs: DataFrame, benchmark: DataFrame, seed: int, coverage: float) -> DataFrame:
    """``contamination`` by row, with its doc_id."""
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    items = saved(benchmark.select(F.monotonically_increasing_id().alias("nr"), "item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
                  .mapInArrow(_ids, f"nr long, item_id {item_type}, words array<long>"),
                  "bench-words")
    held = saved(items.select("nr", "words").mapInArrow(_seeds(seed), "nr long, seeds array<long>")
                 .select("nr", F.explode("seeds").alias("seed")), "bench-seeds")
    slot = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = held.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(seed & 63 AS int))").alias("b"))
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    # At most FILTER_BITS / 64 rows.
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        bits[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    hits = saved(row_texts(docs).mapInArrow(
        _matches(spark.sparkContext.broadcast(bits), seed), f"row long, doc_id {doc_type}, words array<long>, seeds array<long>"),
        "bench-hits")
    pairs = (hits.select("row", F.explode("seeds").alias("seed")).join(held, "seed")
             .select("row", "nr").distinct())
    both = (pairs.join(items, "nr").withColumnRenamed("words", "item")
            .join(hits.select("row", "doc_id", "words"), "row").select("row", "doc_id", "item_id", "item", "words"))
    found = both.mapInArrow(_tiles(seed), f"row long, doc_id {doc_type}, item_id {item_type}, item_words int, covered int, tiles int")
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no benchmark item;
    every row is judged by its own text, also where rows repeat a doc_id or have none."""
    rows = numbered(docs)
    return drop_rows(rows, _found(rows, benchmark, seed, coverage))
