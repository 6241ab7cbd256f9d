"""Ranked lexical search over an inverted index, term at a time and then document at a time.

The index is a table of segments: some documents each, with their terms, postings
in document order and sizes. A search deals segments to tasks and gives each the
weighted items. In a segment the short lists of an item are added up term at a
time; the sums are then one more list with a bound for each block of documents. It is
walked with the long lists document at a time, skipping every block whose
bounds cannot reach the best results so far. Tasks keep their best over all
their segments, and the best of tasks are ranked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.session import work_dir

from .common import saved

#: Terms with repeats after which a segment is closed, and segments in one file.
SEGMENT = 1_000_000
SEGMENTS_IN_FILE = 8
#: Documents of a block that is skipped or scored as a whole.
SPAN = 64
#: A list is short when it has at most one posting for so many documents of its segment.
SHORT = 16
#: Terms of the items that are searched for together.
BATCH_TERMS = 200_000
#: Results of an item, and salts over which its candidates are ranked first.
TOP = 20
SALTS = 32

# Terms are made of 0-9, A-Z as a-z, a-z and everything from U+0080 on, in UTF-8 of all bytes from 0x80 on.
_TERM_BYTES = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _TERM_BYTES else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _segments(most: int):
    """(doc_id, text) -> segments. terms: joined by spaces; ends: where each term's postings
    end; held and tfs: document numbers and frequencies; sizes: terms of each document."""
    names = ["doc_ids", "sizes", "terms", "ends", "held", "tfs", "n_docs", "n_terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, ids, total = _Numbers(), [], [], 0

        def segment():
            sizes = np.array([len(p) for p in parts], np.int64)
            number = np.concatenate(parts) if parts else np.empty(0, np.int64)
            key, tf = np.unique(number * len(parts) + np.repeat(np.arange(len(parts)), sizes), return_counts=True)
            ends = np.searchsorted(key // len(parts), np.arange(len(words)), "right")
            return pa.RecordBatch.from_arrays([
                pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (
                    sizes.tobytes(), b" ".join(words), ends.astype(np.int32).tobytes(), (key % len(parts)).astype(np.int32).tobytes(),
                    tf.astype(np.int32).tobytes())], pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())],
                names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = terms_of(text)
                parts.append(np.fromiter(map(words.__getitem__, got), np.int64, len(got)))
                ids.append(doc)
                total += len(got)
                if total >= most:
                    yield segment()
                    words, parts, ids, total = _Numbers(), [], [], 0
        if parts:
            yield segment()
    return run


def build_index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The saved index of every row of ``docs`` (doc_id, text); null texts have no terms."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    index = texts.mapInArrow(_segments(segment), "doc_ids array<long>, sizes binary, terms binary, ends binary, held binary, tfs binary, "
                             "n_docs long, n_terms long")
    path = work_dir(spark, "llm-index")
    index.write.option("compression", "zstd").option("maxRecordsPerFile", SEGMENTS_IN_FILE).parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def _frequencies(wanted):
    """(terms, ends) of segments -> (term number, documents) of the wanted terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for terms, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.diff(np.frombuffer(ends, np.int32), prepend=0)
                for i, t in enumerate(terms.split()):
                    if t in wanted.value:
                        total[wanted.value[t]] += int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["t", "df"])
    return run


class _Segment:
    """A segment's lists of the wanted terms, scored when first asked for."""

    def __init__(self, sizes, terms, ends, held, tfs, wanted, weight, n_docs, n_terms):
        self.held, self.tfs, self.weight = np.frombuffer(held, np.int32), np.frombuffer(tfs, np.int32), weight
        sizes = np.frombuffer(sizes, np.int64)
        self.docs = len(sizes)
        self.length = 75 + (25 * sizes * n_docs) // max(n_terms, 1)
        ends = np.frombuffer(ends, np.int32)
        self.place = {wanted[t]: (int(ends[i - 1]) if i else 0, int(ends[i])) for i, t in enumerate(terms.split()) if t in wanted}
        self.edges = np.arange(0, self.docs + SPAN, SPAN)
        self.known: dict[int, tuple] = {}

    def list_of(self, t: int):
        """(documents, what each gets from the term, largest in each block, block bounds in the list)."""
        if t not in self.known:
            lo, hi = self.place[t]
            docs, tf = self.held[lo:hi], self.tfs[lo:hi].astype(np.int64)
            gain = int(self.weight[t]) * ((1_000_000_000 * tf) // (1000 * tf + 12 * self.length[docs]))
            bound = np.zeros(len(self.edges) - 1, np.int64)
            np.maximum.at(bound, docs // SPAN, gain)
            self.known[t] = docs, gain, bound, np.searchsorted(docs, self.edges)
        return self.known[t]

    def best(self, item: list[tuple[int, int]], top: int, floor: int, short: int):
        """(documents, scores) of all documents that can be among the best ``top`` and score at least ``floor``."""
        lists = [(self.list_of(t), k) for t, k in item if t in self.place]
        if not lists or sum(int(x[2].max()) * k for x, k in lists) < floor:
            return None
        sums = np.zeros(self.docs, np.int64)
        long = []
        for x, k in lists:  # term at a time
            if len(x[0]) * short <= self.docs:
                sums[x[0]] += x[1] * k
            else:
                long.append((x, k))
        blocks = np.maximum.reduceat(sums, self.edges[:-1]) + sum((x[2] * k for x, k in long), np.zeros(len(self.edges) - 1, np.int64))
        if self.docs > top:  # so many documents have their sums already
            floor = max(floor, int(np.partition(sums, self.docs - top)[self.docs - top]))
        found, scores, count = [], [], 0
        for i in np.flatnonzero(blocks >= max(floor, 1)).tolist():  # document at a time, over all lists
            if blocks[i] < floor:
                continue
            lo = int(self.edges[i])
            score = sums[lo:lo + SPAN].copy()
            for (docs, gain, _, cut), k in long:
                a, b = cut[i], cut[i + 1]
                score[docs[a:b] - lo] += gain[a:b] * k
            own = np.flatnonzero(score >= max(floor, 1))
            if len(own):
                found.append(own + lo)
                scores.append(score[own])
                count += len(own)
                if count > 4 * top:
                    every = np.concatenate(scores)
                    floor = max(floor, int(np.partition(every, len(every) - top)[len(every) - top]))
                    keep = every >= floor
                    found, scores, count = [np.concatenate(found)[keep]], [every[keep]], int(keep.sum())
        return (np.concatenate(found), np.concatenate(scores)) if found else None


def _search(query, top: int, short: int):
    """Segments -> (item, doc_id, score): the task's best of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, items, n_docs, n_terms = query.value
        best: dict[int, list[tuple]] = {}
        floor: dict[int, int] = {}
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column(0)[row].as_py()
                s = _Segment(*(b.column(i)[row].as_py() for i in range(1, 6)), wanted, weight, n_docs, n_terms)
                for number, item in enumerate(items):
                    got = s.best(item, top, floor.get(number, 0), short)
                    if got is None:
                        continue
                    # Ties go to the smaller doc_id; a null one comes first.
                    mine = best.get(number, []) + [(-int(x), ids[d] is not None, ids[d] or 0) for d, x in zip(*(a.tolist() for a in got), strict=True)]
                    mine.sort()
                    best[number] = mine = mine[:top]
                    if len(mine) == top:
                        floor[number] = -mine[-1][0]
        rows = [(n, x[2] if x[1] else None, -x[0]) for n, mine in best.items() for x in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])
    return run


def _batches(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Rows (nr, text) of the items, so many terms at a time; they come to the driver one batch after another."""
    batch, total = [], 0
    for r in items.toLocalIterator():
        terms = Counter(terms_of(bytes(r.text)))
        batch.append((r.nr, terms))
        total += len(terms)
        if total >= most:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


def search(index: DataFrame, items: DataFrame, top: int = TOP, batch_terms: int = BATCH_TERMS, short: int = SHORT) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of the index for each row of
    ``items`` (item_id, text), equal scores by doc_id (null first).

    Every row of ``items`` is an item of its own, also where it repeats one or has no
    id; every row of the documents is one document. Items without terms, or whose terms no document
    has, have no results. No items or no documents give no rows.
    """
    spark: SparkSession = index.sparkSession
    numbered = saved(items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
                     .withColumn("nr", F.monotonically_increasing_id()), "search-items")
    facts = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = facts[0] or 0, facts[1] or 0
    found = None
    for batch in _batches(numbered.select("nr", "text"), batch_terms):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in batch for t in terms))}
        wanted = spark.sparkContext.broadcast(vocabulary)
        df = dict(index.select("terms", "ends").mapInArrow(_frequencies(wanted), "t long, df long")
                  .groupBy("t").agg(F.sum("df")).collect())  # at most one row for each term of the batch
        weight = np.zeros(len(vocabulary), np.int64)
        for t, n in df.items():
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        query = spark.sparkContext.broadcast((vocabulary, weight, [[(vocabulary[t], k) for t, k in terms.items()] for _, terms in batch],
                                              n_docs, n_terms))
        rows = index.drop("n_docs", "n_terms").mapInArrow(_search(query, top, short), "item long, doc_id long, score long")
        # The batch's numbers become those of the items: a small table of the batch.
        own = spark.createDataFrame([(i, nr) for i, (nr, _) in enumerate(batch)], "item long, nr long")
        rows = saved(rows.join(F.broadcast(own), "item").select("nr", "doc_id", "score"), "search-found")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "nr long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("nr", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("nr").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("nr", "item_id"), "nr").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
