"""Phrase collocations by mergeable Misra-Gries summaries and an exact second count.

Phrases are 64-bit hashes while they are being sieved. Tasks sum the hashes of
their texts and cut the sums by hash bucket. For each bucket the sums of all tasks
are merged into a Misra-Gries summary whose capacity exceeds the bucket's mass
divided by the least frequency, so that every phrase that is frequent enough
survives, whatever the order of merging. Survivors become a filter of bounded size.
Words and pairs are sieved first; longer phrases only count where all their pairs
survive. A last pass counts the phrases in the filter exactly, by their words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import mix64, saved, shingle_hashes

#: Words of the longest phrase, occurrences that make a phrase a candidate, phrases reported for each language.
LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text worked on at once, sums a task holds before it passes them on, distinct words it remembers.
BLOCK = 4 << 20
HELD = 3_000_000
WORDS = 500_000
#: Bytes of text for one hash bucket, and the fewest buckets.
BUCKET_BYTES = 1 << 30
BUCKETS = 64
#: The filter has this many bits for a survivor, in lines of 512 bits, between the least and the most lines (64 MB).
FILTER_BITS = 16
LINES = (1 << 12, 1 << 20)
#: Salts over which a language's phrases are ranked first.
SALTS = 64

# A-Z become a-z, tabs become spaces, and all of [.,;:!?\x0A-\x0D] become one mark, which no word contains.
MARK = b"."
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + MARK * 9)


class Vocabulary(dict):
    """Word -> number, with each number's 64-bit hash. The mark is 0 with hash 0."""

    def __init__(self):
        super().__init__()
        self.renew()

    def renew(self):
        self.clear()
        self[MARK] = 0
        self.new, self.hashes = [], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(xxhash.xxh64_intdigest(word) or 1)
        return number

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, hashes) of the words of one block."""
        if len(self) > WORDS:
            self.renew()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.array(self.new, np.uint64)])
            self.new = []
        return numbers, self.hashes[numbers]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words with marks) of about ``size`` bytes of text at a time. Texts are
    joined by marks and long ones cut at marks, so no phrase crosses a cut."""
    held: dict[str, list[bytes]] = defaultdict(list)
    total: dict[str, int] = defaultdict(int)
    split = lambda parts: MARK.join(parts).replace(MARK, b" . ").split()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text.translate(_TABLE)
            while len(text) > size:
                cut = text.rfind(MARK, 0, size) + 1 or text.find(MARK, size) + 1 or len(text)
                yield lang, split([text[:cut]])
                text = text[cut:]
            held[lang].append(text)
            total[lang] += len(text)
            if total[lang] >= size:
                yield lang, split(held.pop(lang))
                total[lang] = 0
    for lang, parts in held.items():
        yield lang, split(parts)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


class Grams:
    """The hashes of the phrases of one block: ``keys(n)`` at the places ``at(n)``."""

    def __init__(self, hashes: np.ndarray, lang: np.uint64):
        self.hashes, self.lang = hashes, lang
        self.marks = np.concatenate([[0], np.cumsum(hashes == 0)])

    def at(self, n: int) -> np.ndarray:
        """Starts of the runs of ``n`` words without a mark."""
        return np.flatnonzero(self.marks[n:] == self.marks[:-n]) if len(self.hashes) >= n else np.empty(0, np.int64)

    def keys(self, n: int) -> np.ndarray:
        """One for every start of the block, with or without marks."""
        with np.errstate(over="ignore"):
            return mix64(shingle_hashes(self.hashes, n) ^ (self.lang + np.uint64(n)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def pruned(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of at most ``capacity`` counters, and what was taken from each:
    the largest count beyond the capacity, so that ``capacity`` + 1 counters or more lose as much."""
    if len(keys) <= capacity:
        return keys, counts, 0
    place = len(counts) - capacity - 1
    cut = int(np.partition(counts, place)[place])
    keep = counts > cut
    return keys[keep], counts[keep] - cut, cut


# --- the filter ------------------------------------------------------------------------------

def _probes(keys: np.ndarray, lines: int) -> np.ndarray:
    """The four bits of every key, all in the line that its upper bits name."""
    line = keys >> np.uint64(64 - (lines.bit_length() - 1))
    return np.stack([(line << np.uint64(9)) + ((keys >> np.uint64(9 * j)) & np.uint64(511)) for j in range(4)]).astype(np.int64)


def in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys may have survived (never false for one that did)."""
    lines = len(bits) // 64
    out = np.ones(len(keys), bool)
    for p in _probes(keys, lines):
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1) != 0
    return out


def _segments(lines: int, buckets: int):
    """Survivors (bucket, keys) -> the lines of the filter that the bucket owns; no other bucket sets their bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = lines * 64 // buckets
        for b in batches:
            for bucket, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits = np.zeros(span, np.uint8)
                p = _probes(np.frombuffer(keys, np.uint64), lines).ravel() - bucket * span * 8
                np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                                                 names=["bucket", "bits"])
    return run


def filter_of(survivors: DataFrame, buckets: int) -> np.ndarray:
    """The filter over ``survivors`` (bucket, keys): ``FILTER_BITS`` bits for each, of bounded
    size; beyond the bound more phrases pass it and are counted in vain."""
    n = survivors.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    lines = max(LINES[0], buckets, min(LINES[1], 1 << ((n // 8 * FILTER_BITS) // 512).bit_length()))
    bits = np.zeros(lines * 64, np.uint8)
    span = lines * 64 // buckets
    for r in survivors.mapInArrow(_segments(lines, buckets), "bucket int, bits binary").collect():  # one row a bucket, the filter's size in all
        bits[r.bucket * span:(r.bucket + 1) * span] = np.frombuffer(r.bits, np.uint8)
    return bits


# --- sieving and counting --------------------------------------------------------------------

def _sums(orders: tuple[int, ...], bits, buckets: int, block: int, held_most: int):
    """(lang, text) -> (bucket, mass, keys, counts): the task's sums, cut by bucket. With a
    filter only phrases all of whose pairs are in it count."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def emit(keys, counts):
        own = (keys >> shift).astype(np.int64)
        edge = np.searchsorted(own, np.arange(buckets + 1))
        some = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
        part = lambda a, i: a[edge[i]:edge[i + 1]]
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([int(part(counts, i).sum()) for i in some], pa.int64()),
            pa.array([part(keys, i).tobytes() for i in some], pa.binary()),
            pa.array([part(counts, i).astype(np.int64).tobytes() for i in some], pa.binary())], names=["bucket", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Vocabulary(), [], 0
        for lang, text in _blocks(batches, block):
            grams = Grams(words.of(text)[1], lang_hash(lang))
            if bits is not None and len(text) > 1:
                out = np.ones(len(text) - 1, bool)
                at = grams.at(2)
                out[at] = ~in_filter(grams.keys(2)[at], bits.value)
                out = np.concatenate([[0], np.cumsum(out)])
            for k in orders:
                at = grams.at(k)
                if bits is not None and len(at):
                    at = at[out[at + k - 1] == out[at]]
                if len(at):
                    keys, counts = np.unique(grams.keys(k)[at], return_counts=True)
                    held.append((keys, counts))
                    n += len(keys)
            if n > held_most:
                held = [merged(held)]
                n = len(held[0][0])
                if n > held_most // 2:
                    yield emit(*held[0])
                    held, n = [], 0
        if n:
            yield emit(*merged(held))
    return run


def _summaries(least: int):
    """(bucket, keys, counts, all: the bucket's mass), sorted by bucket -> the survivors of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, counts, taken, waiting, size, capacity = None, None, None, 0, [], 0, 0

        def pressed():
            nonlocal keys, counts, taken, waiting, size
            keys, counts, cut = pruned(*merged(([(keys, counts)] if keys is not None else []) + waiting), capacity)
            taken, waiting, size = taken + cut, [], 0

        def survivors():
            pressed()
            keep = keys[counts + taken >= least]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([keep.tobytes()], pa.binary())], names=["bucket", "keys"])

        for b in batches:
            for own, k, c, mass in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if own != bucket:
                    if bucket is not None:
                        yield survivors()
                    bucket, keys, counts, taken, waiting, size = own, None, None, 0, [], 0
                    capacity = mass // least + 1
                waiting.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)))
                size += len(waiting[-1][0])
                if size > max(capacity, 1 << 20):
                    pressed()
        if bucket is not None:
            yield survivors()
    return run


def sieve(texts: DataFrame, orders: tuple[int, ...], bits, buckets: int, least: int = LEAST, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(bucket, keys): hashes of all phrases of ``orders`` words that occur ``least`` times
    or more in a language of ``texts`` (lang, text as bytes), and of few others."""
    sums = saved(texts.mapInArrow(_sums(orders, bits, buckets, block, held),
                                  "bucket int, mass long, keys binary, counts binary"), "phrase-sums")
    mass = sums.groupBy("bucket").agg(F.sum("mass").alias("all"))  # one row per bucket
    dealt = (sums.join(F.broadcast(mass), "bucket").select("bucket", "keys", "counts", "all")
             .repartition(buckets, "bucket").sortWithinPartitions("bucket"))
    return saved(dealt.mapInArrow(_summaries(least), "bucket int, keys binary"), "phrase-survivors")


def _exact(bits, longest: int, block: int, buckets: int):
    """(lang, text) -> (bucket, lang, phrases, counts) of the phrases in the filter, joined by marks;
    the empty phrase counts all words. Equal phrases are told by their words'
    numbers, named pair by pair, never by hash; hashes only deal them to buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Vocabulary(), defaultdict(int)

        def table():
            packed = defaultdict(lambda: ([], []))
            for (lang, phrase), n in found.items():
                names, counts = packed[xxhash.xxh64_intdigest(phrase) % buckets, lang]
                names.append(phrase)
                counts.append(n)
            found.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in packed], pa.int32()), pa.array([k[1] for k in packed], pa.string()),
                pa.array([MARK.join(v[0]) for v in packed.values()], pa.binary()),
                pa.array([np.array(v[1], np.int64).tobytes() for v in packed.values()], pa.binary())],
                names=["bucket", "lang", "phrases", "counts"])

        for lang, text in _blocks(batches, block):
            numbers, hashes = words.of(text)
            grams = Grams(hashes, lang_hash(lang))
            found[lang, b""] += int(len(text) - grams.marks[-1])
            for k in range(1, longest + 1):
                at = grams.at(k)
                if not len(at):
                    continue
                at = at[in_filter(grams.keys(k)[at], bits.value)]
                name, wide = numbers[at], np.int64(len(words))
                for j in range(1, k):
                    name = np.unique(name, return_inverse=True)[1] * wide + numbers[at + j]
                _, first, counts = np.unique(name, return_index=True, return_counts=True)
                for i, c in zip(at[first].tolist(), counts.tolist(), strict=True):
                    found[lang, b" ".join(text[i:i + k])] += c
            if len(found) > 500_000:
                yield table()
        if found:
            yield table()
    return run


def _totals(least: int):
    """(bucket, lang, phrases, counts), sorted by bucket and language -> (lang, words, phrase, f) of those
    with f >= ``least``, and of the empty phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, defaultdict(int)

        def table():
            rows = [(phrase.count(b" ") + 1 if phrase else 0, phrase, f) for phrase, f in total.items() if f >= least or not phrase]
            total.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([at[1]] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["lang", "words", "phrase", "f"])

        for b in batches:
            for bucket, lang, phrases, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (bucket, lang) != at:
                    if at is not None:
                        yield table()
                    at = bucket, lang
                for phrase, n in zip(phrases.split(MARK), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    total[phrase] += n
        if at is not None:
            yield table()
    return run


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None,
                block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of 1 to ``longest`` words with f >= ``least``, exact,
    and the number of all words of each language as words = 0."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if buckets is None:
        total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(BUCKETS, 1 << (total // BUCKET_BYTES).bit_length())
    short = sieve(texts, (1, 2), None, buckets, least, block, held)
    every = short
    if longest > 2:
        pairs = spark.sparkContext.broadcast(filter_of(short, buckets))
        every = short.unionByName(sieve(texts, tuple(range(3, longest + 1)), pairs, buckets, least, block, held))
        # A bucket's lines are set once: its survivors of both sieves stand in one row.
        every = saved(every.groupBy("bucket").agg(F.collect_list("keys").alias("k")).select(
            "bucket", F.expr("aggregate(k, cast('' as binary), (a, x) -> concat(a, x))").alias("keys")), "phrase-sieved")
    held_bits = spark.sparkContext.broadcast(filter_of(every, buckets))
    counted = texts.mapInArrow(_exact(held_bits, longest, block, buckets), "bucket int, lang string, phrases binary, counts binary")
    dealt = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang")
    return saved(dealt.mapInArrow(_totals(least), "lang string, words int, phrase string, f long"), "phrases")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, **sizes) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut:
    (lang, rank, phrase, a, l, r, n, score, k); k is the number of words before the cut.

    Null texts are empty, null languages are ``und`` like those that say so. Repeated rows
    count each time. Texts without words give nothing; no rows give no rows. Columns other than lang and
    text are not looked at.
    """
    f = frequencies(docs, least, longest, **sizes)
    total = saved(f.filter("words = 0").select("lang", F.col("f").alias("n")), "phrase-words")  # one row per language
    known = f.filter("words > 0").select("lang", "words", "phrase", "f")
    phrases = known.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    part = lambda k: F.array_join(k, " ")
    w = F.split("phrase", " ", -1)
    # The phrases one word shorter that a candidate holds; longer ones in between are as frequent, so these suffice.
    inner = phrases.filter("words > 2").select("lang", F.col("a").alias("outer"), F.explode(F.array(
        part(F.slice(w, 1, F.col("words") - 1)), part(F.slice(w, 2, F.col("words") - 1)))).alias("phrase"))
    inner = saved(inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer")), "phrase-inner")
    left = saved(phrases.join(inner, ["lang", "phrase"], "left").filter("outer IS NULL OR outer < a").drop("outer"), "phrase-left")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.slice(w, 1, F.col("k"))).alias("first"),
        part(F.slice(w, F.col("k") + 1, F.col("words"))).alias("rest"))
    side = lambda name, to: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    # 1000 a n has up to 37 digits and l r up to 30, which the decimals hold exactly.
    score = F.expr("(cast(1000 * a as decimal(18, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    out = best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"), F.col("c.k").alias("k"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Each salt's best first, so that no task ranks all phrases of a language.
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.drop("salt").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
