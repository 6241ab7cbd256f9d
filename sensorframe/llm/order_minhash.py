"""Near duplicates by Order MinHash, verified by banded alignment.

A text's runs of five words (k-mers) are labelled with their occurrence, so
that repeats count. Every sketch value takes the ``PICKS`` k-mers with
the smallest hashes under its own seed and keeps them in text order: equal
values need the same k-mers in the same order, which follows edit similarity
rather than plain overlap. Texts that share a sketch value are candidates: two
k-mers a value and 64 values find at least 9 in 10 pairs up to the least similarity
that the alignment accepts (measured in the README and in the tests).
Candidates are aligned word by word inside a band; at least ``SIMILARITY`` of
the longer text must stay without edits.

Copies with the same words collapse first. Every text is compared with the
leader of its most shared sketch value (in large groups with a sub-leader, which
is compared with the leader), and linked texts form classes; in every value,
the leader of each class is then compared with the value's leader. Leaders are the texts that
share their values with the most others. Then members of one sketch value that
are still in different classes are compared with each other, unless a bound
on word counts already rules them out, and the classes are joined. Pairs inside
one class need no comparison, because the classes would not change. A value
with many members in several classes comes from a passage that unrelated
texts share; its members are compared when they share one of their rarest
pairs of words too, which all that pass the alignment do (``rare_kmers``), and when their
words themselves (``bags``) and not only rough counts of them leave the pair possible: the
classes are the same as if all members were compared. No sketch value is cut short.
What is left is compared at once where it is a few pairs for each text, and else round by
round, nearest first by the bound, so that a large group grows together by as many comparisons as it has texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, keep_rows, list_column, mix64, numbered, row_texts, saved, shingle_hashes
from .components import components

#: Words of a k-mer, k-mers of a sketch value, sketch values of a text, least similarity.
KMER, PICKS, SKETCHES, SIMILARITY = 5, 2, 64, 0.8
#: Sub-leaders of one sketch value.
SUBLEADERS = 256
#: Members of a sketch value in several classes beyond which pairs are found by a shared rare word;
#: it changes the work, not the classes.
WIDE = 64
#: Members of a k-mer that one task compares with all of its members.
DEAL = 64
#: Words of the k-mers of which members of such values must share a rare one.
RARE = 2
#: Places, by hash, that tell roughly how many texts hold a k-mer; it changes the work, not the classes.
PLACES = 1 << 18
#: Pairs for each different text up to which what is left is compared at once, without rounds; it changes the
#: work and which links form the classes, not the classes.
AT_ONCE = 4
#: Slots of the word counts that bound the edits between two texts from below.
SLOTS = 128
#: Words of a text up to which its words bound the edits too, where many texts meet; it changes the work, not the classes.
BAG = 4096
#: Bits, by hash, of a text's words that rule out most pairs of a k-mer before the words themselves are
#: fetched (a multiple of 64); it changes the work, not the classes.
BITS = 512
WORD = re.compile(r"\w+")


def labelled_kmers(ids: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hashes of the k-mers of a word sequence with their occurrence: the first,
    second, ... of equal k-mers differ."""
    grams = shingle_hashes(ids, k)
    n = len(grams)
    if not n:
        return grams
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype(np.uint64)
    return mix64(grams + nth * np.uint64(0x9E3779B97F4A7C15))


#: Hashes of k-mers under several seeds that are held at once.
CELLS = 1 << 16


def sketch(ids: np.ndarray, k: int = KMER, picks: int = PICKS, sketches: int = SKETCHES) -> np.ndarray:
    """Sketch values of a word sequence; none for fewer than ``k`` words. With
    fewer k-mers than ``picks`` all of them are taken."""
    labelled = labelled_kmers(ids, k)
    n = len(labelled)
    if not n:
        return np.empty(0, np.uint64)
    take, step = min(picks, n), max(1, CELLS // n)
    seeds = np.arange(1, sketches + 1, dtype=np.uint64)
    out = []
    for s in range(0, sketches, step):
        v = seeds[s:s + step]
        h = (labelled ^ (v * np.uint64(0x632BE59BD9B4E019))[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        line, at = np.arange(len(v)), np.empty((len(v), take), np.int64)
        for i in range(take):  # the smallest, then the smallest of the rest, ...
            at[:, i] = h.argmin(axis=1)
            h[line, at[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for g in labelled[np.sort(at, axis=1)].T:  # in text order
            v = (v * np.uint64(0xFF51AFD7ED558CCD)) ^ g
            v ^= v >> np.uint64(29)
        out.append(v)
    return np.concatenate(out)


def band_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else
    ``most + 1``. The alignment keeps to the band of ``most`` cells beside the
    diagonal; one bit per cell of a band's column holds whether it is one more
    or one less than its neighbour."""
    if len(a) > len(b):
        a, b = b, a
    tail = 0
    while tail < len(a) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b, lead = a[:len(a) - tail], b[:len(b) - tail], 0
    while lead < len(a) and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    # Column j of the band holds rows j - most .. j + most of a; rows outside a match nothing.
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full ^ ((1 << most) - 1), 0
    score = min(most, len(a))
    last = len(a) - 1
    # score follows the diagonal cell of the band's lowest row, then the last row of a.
    top = 1 << (width - 1)
    for j, x in enumerate(b):
        low = j - most
        m = at.get(x, 0)
        m = (m >> low if low >= 0 else m << -low) & full
        d0 = ((((m & up) + up) ^ up) | m | down) & full
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        end = j + most  # lowest row of the band in this column
        if end <= last:
            score += not d0 & top
        else:
            bit = 1 << (width - 1 - (end - last))
            score += bool(hp & bit) - bool(hn & bit)
        shifted = d0 >> 1
        up = (hn | ~(shifted | hp)) & full
        down = shifted & hp
    return min(score, most + 1)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, pack = WordIds(), zstandard.ZstdCompressor(level=1)
    for b in batches:
        h1, h2, size, slots, sketches, body = [], [], [], [], [], []
        for t in b.column(2):
            words = WORD.findall(t.as_py().lower())
            w = ids.of(words)
            d = xxhash.xxh3_128_digest(w.tobytes())
            h1.append(int.from_bytes(d[:8], "little", signed=True))
            h2.append(int.from_bytes(d[8:], "little", signed=True))
            size.append(len(w))
            slots.append(np.bincount((w % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).clip(max=32767).astype(np.int16))
            sketches.append(sketch(w).view(np.int64))
            body.append(pack.compress(" ".join(words).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int32()),
             list_column(slots, pa.int16()), list_column(sketches, pa.int64()), pa.array(body, pa.binary())],
            names=["row", "doc_id", "h1", "h2", "size", "slots", "sketch", "body"])


def _kmers_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    """(batch, place in it, number of words, labelled k-mers) for every row of (body, ...)."""
    ids, unpack = WordIds(), zstandard.ZstdDecompressor()
    for b in batches:
        for i, x in enumerate(b.column(0)):
            words = unpack.decompress(x.as_py()).decode("utf-8", "surrogatepass").split(" ")
            yield b, i, len(words), labelled_kmers(ids.of(words), k)


def _places(kmers: np.ndarray, places: int) -> np.ndarray:
    """The two places of every k-mer, the second ones after all first ones."""
    at = np.uint64(places)
    return np.stack([kmers % at, mix64(kmers) % at + at]).astype(np.int64)


def _place_counts(k: int, places: int):
    """(place, texts): how many texts of the task hold the k-mers of each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(2 * places, np.int64), [], 0
        for _, _, _, kmers in _kmers_of(batches, k):
            held.append(_places(kmers, places).ravel())
            size += len(kmers)
            if size > 500_000:
                total += np.bincount(np.concatenate(held), minlength=2 * places)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=2 * places)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["place", "texts"])
    return run


def _rarest(k: int, similarity: float, counts):
    """(row, label, kmer, before): the rarest k-mers of each row of (body, row, label), each with the one ranked before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = counts.value
        held, size = [], 0

        def out():
            rows, labels, kmers = zip(*held, strict=True)
            times = [len(x) for x in kmers]
            every = np.concatenate(kmers).view(np.int64)
            first = np.zeros(len(every), bool)
            first[np.cumsum([0, *times[:-1]])] = True
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(rows, times), pa.int64()), pa.array(np.repeat(labels, times), pa.int64()),
                pa.array(every), pa.array(np.roll(every, 1), mask=first)], names=["row", "label", "kmer", "before"])
        for b, i, n, kmers in _kmers_of(batches, k):
            if not len(kmers):
                continue
            rarest = min(len(kmers), int(k * (1 - similarity) * n + 1e-9) + 1)
            order = np.lexsort((kmers, texts[_places(kmers, len(texts) // 2)].min(axis=0)))[:rarest]
            held.append((b.column(1)[i].as_py(), b.column(2)[i].as_py(), kmers[order]))
            size += rarest
            if size > 500_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()
    return run


def rare_kmers(texts: DataFrame, similarity: float = SIMILARITY, k: int = RARE) -> DataFrame:
    """(row, label, kmer, members) for the rarest k-mers of each row of ``texts`` (row, body and, if there are
    classes, label), as far as a row of another class has them too. An edit breaks up to ``k`` k-mers, so a row
    of n words lacks at most ``k * (1 - similarity) * n`` k-mers of a row that is
    near to it, and the two share one among that many rarest and one more: ranked in
    one order, the rarest common k-mer can't come later in either. K-mers that bring no
    new pair together are left out. That holds for
    every pair of word-edit similarity ``similarity`` that has a k-mer in common at
    all (for pairs of words and 0.8: from four words on). K-mers are ranked by the number
    of texts that hold one of the same place, of ``PLACES`` by hash (the lesser of two such numbers), then by hash: any one
    order finds the same pairs near, and this one needs a table of fixed size and no join of all k-mers with their counts."""
    spark = texts.sparkSession
    counted = (texts.select("body").mapInArrow(_place_counts(k, PLACES), "place int, texts long")
               .groupBy("place").agg(F.sum("texts").alias("texts")).toArrow())
    counts = np.zeros(2 * PLACES, np.int64)
    counts[counted["place"].to_numpy()] = counted["texts"].to_numpy()
    label = F.col("label" if "label" in texts.columns else "row").cast("long").alias("label")
    rare = saved(texts.select("body", F.col("row").cast("long"), label).mapInArrow(
        _rarest(k, similarity, spark.sparkContext.broadcast(counts)),
        "row long, label long, kmer long, before long"), "omh-rare")
    # A k-mer that follows one and the same k-mer in all its rows adds no pair to that one's; of a passage
    # that many rows share, only the first k-mers are left.
    several = rare.groupBy("kmer").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("before").alias("first"), F.max("before").alias("last"),
        F.count_if(F.col("before").isNull()).alias("starts"), F.count(F.lit(1)).alias("members")).filter(
        "lo < hi and (first < last or starts > 0)")
    return rare.join(several.select("kmer", "members"), "kmer").select("row", "label", "kmer", "members")


def _bag_rows(most: int):
    """(row, words, bits): the labelled words of each row of (body, row), 16 bits of each, and which of ``BITS`` bits
    they fall on; null for more than ``most`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            rows, words, bits = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.list_(pa.int16())),
                                               pa.array(bits, pa.list_(pa.int64()))], names=["row", "words", "bits"])
        for b, i, n, words in _kmers_of(batches, 1):
            bag = bits = None
            if n <= most:
                bag = np.unique(words.astype(np.uint16))
                bits = np.packbits(np.bincount(bag % BITS, minlength=BITS) > 0).view(np.int64)
                bag = bag.view(np.int16)
            held.append((b.column(1)[i].as_py(), bag, bits))
            size += 0 if bag is None else len(bag)
            if size > 500_000 or len(held) >= 10_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()
    return run


def bags(texts: DataFrame) -> DataFrame:
    """(row, words, bits) for each row of ``texts`` (row, body): its words as a set of small numbers, the first, second, ...
    of equal words by different ones, and the same as a set of still smaller ones, a bit each. An edit takes one word away
    and adds one at most, and words that fall on one number only lower the difference, so what one text has and the other
    lacks bounds the edits from below."""
    return texts.select("body", F.col("row").cast("long")).mapInArrow(
        _bag_rows(BAG), "row long, words array<smallint>, bits array<long>")


def _aligned(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        words = lambda x: unpack.decompress(x.as_py()).decode("utf-8", "surrogatepass").split(" ")
        for b in batches:
            same = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = words(x), words(y)
                most = int((1 - similarity) * max(len(p), len(q)) + 1e-9)
                same.append(band_distance(p, q, most) <= most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same)], names=["a", "b", "same"])
    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, label: str) -> DataFrame:
    """``pairs`` (a, b) with ``same``; each side's text is fetched once per pair."""
    used = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    bodies = saved(texts.join(used, "row", "left_semi").select("row", "body"), label + "-texts")
    left = bodies.select(F.col("row").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("row").alias("b"), F.col("body").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        _aligned(similarity), "a long, b long, same boolean")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, class_size, n_links, kept).

    class_id is the smallest doc_id of the class (null sorts first), class_size
    its rows, n_links the links of the document's text that were verified to form the class,
    kept whether the row stays (one per class). Words are runs of letters, digits
    and underscores in lower case. Texts with the same words are copies of each
    other; texts without words (null, empty, signs only) are near to nothing.
    Texts of fewer than five words are near only to copies.
    """
    return _classes(docs, similarity).drop("row")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """``near_duplicates`` with the row."""
    source = row_texts(docs)
    doc_type = source.schema["doc_id"].dataType.simpleString()
    table = saved(source.mapInArrow(
        _sketch_rows, f"row long, doc_id {doc_type}, h1 long, h2 long, size int, slots array<smallint>, "
                      "sketch array<long>, body binary"), "omh-table")
    # Copies collapse to their first row; texts without words stay apart.
    own = F.when(F.col("size") == 0, F.col("row")).otherwise(F.lit(-1))
    groups = saved(table.withColumn("own", own).groupBy("h1", "h2", "size", "own").agg(
        F.min("row").alias("rep")), "omh-groups")
    member = saved(table.withColumn("own", own).select("row", "doc_id", "h1", "h2", "size", "own").join(
        groups, ["h1", "h2", "size", "own"]).select("row", "doc_id", "rep"), "omh-members")
    reps = groups.filter("size >= " + str(KMER)).select(F.col("rep").alias("row"))
    drawn = saved(table.select("row", "size", "slots", "sketch").join(reps, "row", "left_semi")
                  .select("row", F.explode("sketch").alias("value")), "omh-values")
    # Values of one text need no comparison.
    many = drawn.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    live = saved(drawn.join(many, "value"), "omh-live")
    # Of near copies of one text, those with the fewest edits share their values with the most texts; they lead.
    weight = saved(live.groupBy("row").agg(F.sum("members").alias("weight"),
                                           F.max(F.struct("members", "value"))["value"].alias("value")), "omh-weight")
    facts = saved(table.select("row", "size", "slots").join(weight.select("row"), "row", "left_semi"), "omh-facts")
    # First every text with the leader of its most shared value, through a sub-leader.
    chosen = weight.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SUBLEADERS)))
    subs = saved(chosen.groupBy("value", "salt").agg(_leader().alias("sub")), "omh-subs")
    heads = saved(subs.groupBy("value").agg(F.max("sub").alias("head")), "omh-heads")
    to_sub = _pair(chosen.join(subs, ["value", "salt"]), -F.col("sub.no"), F.col("row"))
    to_head = _pair(subs.join(heads, "value"), -F.col("head.no"), -F.col("sub.no"))

    def test(pairs, done, step):
        fresh = pairs.filter("a <> b").distinct()
        if done is not None:
            fresh = fresh.join(done.select("a", "b"), ["a", "b"], "left_anti")
        if done is None or step == "omh-2":  # later pairs were bounded by the join that made them
            fresh = _possible(fresh, facts, similarity)
        got = saved(verified(saved(fresh, "omh-pairs"), table, similarity, step), "omh-tested")
        return got if done is None else saved(done.unionByName(got), "omh-tested")

    def classes_of(tested):
        label = components(tested.filter("same").select("a", "b"))
        who = weight.join(label, weight["row"] == label["node"], "left").select(
            F.col("row").alias("node"), F.coalesce("label", "row").alias("label"), "weight")
        return label, live.join(who, live["row"] == who["node"]).select("value", "row", "label", "weight")

    tested = test(to_sub.unionByName(to_head), None, "omh-1")
    _, placed = classes_of(tested)
    # Then the first text of every class in a value with the value's first text.
    firsts = saved(_mixed(placed).groupBy("value", "label").agg(
        _leader().alias("first")), "omh-firsts")
    heads = saved(firsts.groupBy("value").agg(F.max("first").alias("head")), "omh-heads")
    tested = test(_pair(firsts.join(heads, "value"), -F.col("head.no"), -F.col("first.no")), tested, "omh-2")
    label, placed = classes_of(tested)
    # Last, members of one value in different classes, compared once each.
    split = saved(_mixed(placed.drop("weight")), "omh-split")
    few = saved(split.filter(F.col("members") <= WIDE).select("value", "row", "label").join(facts, "row"), "omh-few")
    # Both sides are the same rows, so that they are dealt out once.
    l, r = few.alias("l"), few.alias("r")
    across = l.join(r, (F.col("l.value") == F.col("r.value")) & (F.col("l.row") < F.col("r.row"))
                    & (F.col("l.label") != F.col("r.label")) & _in_reach("l.", "r.", similarity)).select(*_pair_edits())
    placed = saved(split.filter(F.col("members") > WIDE).groupBy("row", "label").agg(F.collect_set("value").alias("wide")), "omh-wide")
    bodies = table.select("row", "body").join(placed.select("row", "label"), "row")
    known = saved(placed.join(facts, "row").join(bags(bodies), "row"), "omh-known")
    # Most rows of a rare k-mer share it by chance. Small bits of their words rule those out, so that only rows that
    # may be near to another one take their words and counts along: k-mers are many for each text, these rows are few.
    # Dealt by row, so that the members of one k-mer start in many tasks.
    keyed = saved(rare_kmers(bodies, similarity).select(
        F.col("kmer").alias("value"), "row", F.ceil(F.col("members") / DEAL).cast("int").alias("parts"))
        .join(known.select("row", "label", "wide", "size", "bits"), "row").repartition("row"), "omh-keyed")
    met = _held(keyed, F.arrays_overlap("l.wide", "r.wide")
                & (F.abs(F.col("l.size") - F.col("r.size")) <= _most_edits("l.", "r.", similarity))
                & F.coalesce(_bit_edits("l.", "r.") <= _most_edits("l.", "r.", similarity), F.lit(True)),
                "left_semi", "value", "row", "parts")
    met = saved(met.join(known.drop("bits"), "row").repartition("row"), "omh-met")
    across = across.union(_held(
        met, (F.col("l.row") < F.col("r.row")) & F.arrays_overlap("l.wide", "r.wide") & _in_reach("l.", "r.", similarity)
        & F.coalesce(_bag_edits("l.", "r.") <= _most_edits("l.", "r.", similarity), F.lit(True)),
        "inner", *_pair_edits())).distinct()
    left = saved(across.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "omh-across")
    # Round by round every class and every text first meets the one that word counts leave nearest;
    # when that links nothing more, or pairs are few for the texts, what is still in different classes is
    # compared to the last pair.
    linking, few = True, AT_ONCE * reps.count()
    while True:
        of_a, of_b = (label.select(F.col("node").alias(x), F.col("label").alias("l" + x)) for x in "ab")
        left = saved(left.select("a", "b", "edits").join(of_a, "a", "left").join(of_b, "b", "left").select(
            "a", "b", "edits", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).filter("la <> lb")
            .join(tested.select("a", "b"), ["a", "b"], "left_anti"), "omh-left")
        pairs = left.count()
        if not pairs:
            break
        linking = linking and pairs > few
        nearest = left.select("a", "b")
        if linking:
            best = [left.groupBy(side).agg(F.min(F.struct("edits", "a", "b")).alias("p")).select("p.a", "p.b")
                    for side in ("la", "lb", "a", "b")]
            nearest = best[0].union(best[1]).union(best[2]).union(best[3]).distinct()
        got = saved(verified(saved(nearest, "omh-pairs"), table, similarity, "omh-3"), "omh-tested")
        tested = saved(tested.unionByName(got), "omh-tested")
        linked = not got.filter("same").isEmpty()
        if linked:
            label, _ = classes_of(tested)
        if not linking:
            break
        linking = linked
    links = tested.filter("same").select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    # Back to rows: every row takes the class of its representative.
    rows = member.join(label, member["rep"] == label["node"], "left").select(
        "row", "doc_id", "rep", F.coalesce("label", "rep").alias("label"))
    rows = saved(rows, "omh-rows")
    # Saved, so that the join below is a plain one whose large classes Spark can split.
    classes = saved(rows.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"),
                                              F.min(F.struct("doc_id", "row")).alias("best")), "omh-classes")
    return (rows.join(classes, "label").join(degree, F.col("rep") == F.col("node"), "left")
            .select("row", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size",
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    (F.col("row") == F.col("best.row")).alias("kept")))


def _leader():
    """The row of the greatest weight, then the first, as (weight, -row)."""
    return F.max(F.struct("weight", (-F.col("row")).alias("no")))


def _pair(df: DataFrame, x, y) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (value, row, label, ...) whose value has several labels,
    with the value's number of members."""
    several = placed.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                          F.count(F.lit(1)).alias("members")).filter("lo < hi")
    return placed.join(several.select("value", "members"), "value")


def _least_edits(a: str, b: str):
    """Edits that word counts (columns size and slots of two sides) leave needed at
    least: an edit changes the counts of the slots by one up and one down at most, so
    the larger of the words to add and the words to remove bounds them from below."""
    gain = F.aggregate(F.zip_with(F.col(a + "slots"), F.col(b + "slots"), lambda x, y: F.greatest(x - y, F.lit(0))),
                       F.lit(0), lambda s, x: s + x)
    return F.greatest(gain, gain + F.col(b + "size") - F.col(a + "size"))


def _bag_edits(a: str, b: str):
    """Edits that the words of two sides (``bags``) leave needed at least; null where a side has none."""
    x, y = F.col(a + "words"), F.col(b + "words")
    return F.greatest(F.array_size(x), F.array_size(y)) - F.array_size(F.array_intersect(x, y))


def _bit_edits(a: str, b: str):
    """The same by the bits of their words."""
    def lacks(a, b):
        return sum((F.bit_count(F.get(F.col(a + "bits"), i).bitwiseAND(F.bitwise_not(F.get(F.col(b + "bits"), i))))
                    for i in range(BITS // 64)), F.lit(0))
    return F.greatest(lacks(a, b), lacks(b, a))


def _pair_edits():
    """A pair of the sides l and r with the edits that word counts leave needed."""
    return F.col("l.row").alias("a"), F.col("r.row").alias("b"), _least_edits("l.", "r.").alias("edits")


def _held(keyed: DataFrame, condition, how: str, *columns) -> DataFrame:
    """Rows of ``keyed`` (value, row, label, parts, ...) joined as l and r with those of the same value and another label. A value
    of many members is compared in parts, a part of them with all of them; of the others both sides are the same
    rows and columns, so that they are dealt out once."""
    apart = (F.col("l.value") == F.col("r.value")) & (F.col("l.label") != F.col("r.label")) & (F.col("l.row") != F.col("r.row")) & condition
    few = keyed.filter("parts = 1").drop("parts")
    many = keyed.filter("parts > 1")
    l = many.withColumn("part", F.pmod(F.hash("row"), "parts")).alias("l")
    r = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("r")
    out = few.alias("l").join(few.alias("r"), apart, how).withColumn("parts", F.lit(1)).select(*columns)
    return out.union(l.join(r, (F.col("l.part") == F.col("r.part")) & apart, how).select(*columns))


def _most_edits(a: str, b: str, similarity: float):
    return F.lit(1 - similarity) * F.greatest(F.col(a + "size"), F.col(b + "size")) + 1e-9


def _in_reach(a: str, b: str, similarity: float):
    """Whether word counts leave a pair possible."""
    most = _most_edits(a, b, similarity)
    return (F.abs(F.col(a + "size") - F.col(b + "size")) <= most) & (_least_edits(a, b) <= most)


def _possible(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """Pairs that word counts don't rule out."""
    return (pairs.join(facts.withColumnRenamed("row", "a").alias("x"), "a")
            .join(facts.withColumnRenamed("row", "b").alias("y"), "b")
            .filter(_in_reach("x.", "y.", similarity)).select("a", "b"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each class, also
    where rows repeat a doc_id or have none."""
    rows = numbered(docs)
    return keep_rows(rows, _classes(rows, similarity).filter("kept"))
