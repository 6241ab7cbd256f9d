"""Removal of repeated substrings, over suffixes sorted by external induction.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier
(smaller doc_id, or the same document further left) goes; overlaps count.

1. Texts are cut into factors: maximal runs of string starts whose strings
   have the same smallest ``GRAM``-byte gram at the same place. The gram depends on
   the string alone, so equal strings fall into factors with equal grams,
   at the same offset from it. Equal factors are recognised by 128 bits of hash
   and only the first of them goes on, as equal substrings share a name in
   induced sorting; all strings of the others start earlier too.
2. A gram of one distinct factor settles it: its strings are new. Grams of several
   distinct factors are dealt to shards by gram, and each shard sorts the suffixes
   of its factors with their common prefixes (``induced_sort``). Strings of
   suffixes with ``LENGTH`` bytes in common are equal; the first of them stays.
   Grams of very many distinct factors (``HOT``) are not left to one shard: their
   strings are compared one by one, over all tasks, by 128 bits of hash.
3. What is left of every document follows from the strings that are new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, list_column, mix64, saved
from .induced_sort import sorted_suffixes

#: Bytes of a string, bytes of the gram that names its factor.
LENGTH, GRAM = 100, 32
#: String starts cut at a time; bytes of factors that one task sorts; factors of one gram beyond which its strings are dealt one by one.
PIECE, SHARD, HOT = 1 << 18, 2_000_000, 20_000
#: Bytes of text whose factors are compared before they are dealt.
BLOCK = 4_000_000
#: Bytes of short texts or factors that go through the array operations together.
PACK = 1 << 17


class Roller:
    """Hashes of all substrings of a piece from two multiplications each."""

    def __init__(self, base: int, seed: int, size: int):
        self.letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
        self.up = np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64)), dtype=np.uint64)
        back = pow(base, -1, 1 << 64)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(size, back, np.uint64)), dtype=np.uint64)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = self.letters.take(data)
        values *= self.up[:len(data)]
        np.cumsum(values, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        values = self.sums[size:] - self.sums[:n]
        values *= self.down[:n]
        return mix64(values)


def every(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every entry the ``counts`` numbers from ``begins`` on, one after the other."""
    return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


def window_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:len(v) - (w - span)], v[w - span:]) if w > span else v


def pieces(texts: list[np.ndarray], length: int, piece: int, pack: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(number of the text, first byte, bytes) of the pieces that texts are cut
    in, in order; short ones come together, up to ``pack`` bytes."""
    which, at, parts, held = [], [], [], 0
    for i, data in enumerate(texts):
        for lo in range(0, len(data) - length + 1, piece):
            part = data[lo:lo + piece + length - 1]
            if parts and held + len(part) > pack:
                yield np.array(which), np.array(at), parts
                which, at, parts, held = [], [], [], 0
            which.append(i)
            at.append(lo)
            parts.append(part)
            held += len(part)
    if parts:
        yield np.array(which), np.array(at), parts


def factors(parts: list[np.ndarray], gram_hash: Roller, whole_hash: Roller, length: int, gram: int):
    """(number of the part, gram hash, whole hash, first start, number of starts)
    of the factors of some pieces of text. A piece's end cuts a factor in two, which then
    count as different factors of one gram."""
    data = np.concatenate(parts) if len(parts) > 1 else parts[0]
    symbols = data.astype(np.intp)
    gram_hash.load(symbols)
    whole_hash.load(symbols)
    g = gram_hash.grams(gram)
    # High bits of the hash, then the position: the leftmost of equal grams.
    keys = g >> np.uint64(20)
    keys <<= np.uint64(20)
    keys |= np.arange(len(g), dtype=np.uint64)
    sizes = np.array([len(p) for p in parts])
    begins, counts = np.cumsum(sizes) - sizes, sizes - (length - 1)
    # Starts of strings that end in their own part. Grams of different parts lie at different places.
    starts = every(begins, counts)
    chosen = (window_least(keys, length - gram + 1)[starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
    edge = np.append(0, np.flatnonzero(chosen[1:] != chosen[:-1]) + 1)
    n = np.diff(np.append(edge, len(chosen)))
    first, chosen = starts[edge], chosen[edge]
    whole = whole_hash.of(first, first + n + (length - 1))
    # Where the gram lies inside is part of the name.
    whole = mix64(whole + (chosen - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    part = np.repeat(np.arange(len(parts)), counts)[edge]
    return part, g[chosen], whole, first - begins[part], n


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        raw = b.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([
            b.column(0), b.column(1), pa.array([len(x) for x in raw], pa.int64()),
            pa.array([z.compress(x) for x in raw], pa.binary())], names=["row", "doc_id", "n_bytes", "body"])


def _unpack(bodies: pa.Array, order: list[int] | None = None) -> Iterator[bytes]:
    z = zstandard.ZstdDecompressor()
    for i in range(len(bodies)) if order is None else order:
        yield z.decompress(bodies[i].as_buffer())


def _distinct(parts: list[tuple]) -> pa.RecordBatch:
    """Factors in order of (doc, row, start) -> the first of those that are equal."""
    g, h, d, r, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(mix64(g) + h, kind="stable")
    # Others between equals only leave a factor twice.
    new = np.append(True, (g[by][1:] != g[by][:-1]) | (h[by][1:] != h[by][:-1]))
    at = by[new]  # stable: the first in order of (doc, row, start)
    return pa.RecordBatch.from_arrays(
        [pa.array(x[at]) for x in (g.view(np.int64), h.view(np.int64), d.astype(np.int64), r.astype(np.int64),
                                   s.astype(np.int64))] + [pa.array(n[at].astype(np.int32))],
        names=["gram", "whole", "doc", "row", "start", "n"])


def _cut(length: int, gram: int, piece: int, block: int, pack: int = PACK):
    """(row, doc, body) -> (gram, whole, doc, row, start, n): the first of equal
    factors in each block of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(piece + length, pack)
        a = Roller(0x5851F42D4C957F2D, 0x9E3779B97F4A7C15, size)
        b = Roller(0xDA942042E4DD58B5, 0xC2B2AE3D27D4EB4F, size)
        for batch in batches:
            rows, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            order = np.lexsort((rows, docs))
            rows, docs = rows[order], docs[order]
            texts, lo, held = [], 0, 0
            for i, raw in enumerate(_unpack(batch.column(2), order.tolist())):
                texts.append(np.frombuffer(raw, np.uint8))
                held += len(raw)
                if held >= block or i == len(order) - 1:
                    parts = []
                    for which, at, some in pieces(texts, length, piece, pack):
                        of, g, h, s, n = factors(some, a, b, length, gram)
                        text = lo + which[of]
                        parts.append((g, h, docs[text], rows[text], s + at[of], n))
                    if parts:
                        yield _distinct(parts)
                    texts, lo, held = [], i + 1, 0
    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, whole, doc, row, start) -> the first row of every
    (gram, whole), with whether its gram has several. One row is held back
    until the next one is known."""
    names = ["gram", "doc", "row", "start", "n"]
    last, several = None, False  # the row held back; whether a row before it has its gram
    tail = None
    for b in batches:
        if not b.num_rows:
            continue
        g, h = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.append(tail is None or (g[0], h[0]) != tail, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
        tail = (g[-1], h[-1])
        at = np.flatnonzero(new)
        if not len(at):
            continue
        cols = [b.column(k).to_numpy()[at] for k in (0, 2, 3, 4, 5)]
        if last is not None:
            cols = [np.append(x, y).astype(y.dtype) for x, y in zip(last, cols, strict=True)]
        g = cols[0]
        same = g[1:] == g[:-1]  # with the row after
        many = np.append(same, False) | np.append(several if last is not None else False, same)
        last, several = [x[-1:] for x in cols], bool(same[-1]) if len(same) else several
        if len(g) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in cols] + [pa.array(many[:-1])], names=[*names, "many"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last] + [pa.array([several])], names=[*names, "many"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of each row's list and the fields of all its structs as arrays; a
    null list has no entries."""
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.append(0, np.cumsum(sizes)), [f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each row's bytes, and all bytes in one array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def _binary(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column from its rows' bounds in ``data``."""
    offsets = pa.py_buffer(bounds.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring rows of ``most`` bytes together, or of one larger row."""
    lo, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and held + size > most:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _slices(length: int, pack: int = 8 * PACK):
    """(row, doc, body, want) -> (gram, doc, row, start, n, hot, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, (gram, start, n, hot) = _lists(b.column(3))
            rows, docs = (b.column(k).to_numpy() for k in (0, 1))
            total = np.append(0, np.cumsum(n + (length - 1), dtype=np.int64))[cuts]
            texts = _unpack(b.column(2))
            for lo, hi in _chunks(np.diff(total), pack):
                parts, at = [], slice(cuts[lo], cuts[hi])
                for i in range(lo, hi):
                    raw, one = next(texts), slice(cuts[i], cuts[i + 1])
                    parts += [raw[s:e] for s, e in zip(start[one].tolist(), (start[one] + n[one] + (length - 1)).tolist(), strict=True)]
                k = np.repeat(np.arange(lo, hi), np.diff(cuts[lo:hi + 1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram[at]), pa.array(docs[k]), pa.array(rows[k]), pa.array(start[at]),
                    pa.array(n[at]), pa.array(hot[at].astype(bool)), pa.array(parts, pa.binary())],
                    names=["gram", "doc", "row", "start", "n", "hot", "part"])
    return run


def _runs(rows: np.ndarray, starts: np.ndarray, begins: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """(row, start, n) of the maximal runs of new starts in each factor.
    ``begins`` are the factors' places in ``new``, where none touch."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], new.astype(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    of = np.searchsorted(begins, lo, side="right") - 1
    return pa.RecordBatch.from_arrays([pa.array(rows[of]), pa.array(starts[of] + lo - begins[of]),
                                       pa.array((hi - lo).astype(np.int32))], names=["row", "start", "n"])


def _sort_shard(length: int, memory: int | None, base: int | None):
    """Factors of a shard in order of (doc, row, start) -> runs of new strings."""
    more = {k: v for k, v in (("memory", memory), ("base", base)) if v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, starts, sizes, lengths, parts = [], [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            for k, column in ((2, rows), (3, starts), (4, sizes)):
                column.append(b.column(k).to_numpy().astype(np.int64))
            bounds, data = _bytes(b.column(6))
            lengths.append(np.diff(bounds) + 1)
            parts.append(data)
        if not rows:
            return
        rows, starts, sizes, lengths, data = (np.concatenate(x) for x in (rows, starts, sizes, lengths, parts))
        del parts
        # Bytes from 2 on, which fit in one byte as UTF-8 has none above 244; 1 ends a factor, 0 the whole. Text order is the order of precedence.
        ends = np.cumsum(lengths)
        begins = ends - lengths
        t = np.ones(ends[-1] + 1, np.uint8 if data.max() <= 253 else np.uint16)
        t[-1] = 0
        t[every(begins, lengths - 1)] = data.astype(t.dtype) + t.dtype.type(2)
        del data
        valid = np.zeros(len(t), bool)
        valid[every(begins, sizes)] = True
        seen = np.zeros(len(t), bool)
        for suffixes, prefix in sorted_suffixes(t, length, **more):
            ok = valid[suffixes]
            group = np.cumsum(prefix < length)[ok]
            at = suffixes[ok]
            if not len(at):
                continue
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(at, cut)
            seen[at] = True
            seen[least] = False
        yield _runs(rows, starts, begins, valid & ~seen)
    return run


def _strings(length: int, pack: int = PACK):
    """Factors -> (a, b, doc, row, start): 128 bits of hash of every string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = y = None
        for b in batches:
            if not b.num_rows:
                continue
            bounds, data = _bytes(b.column(6))
            docs, rows, starts, n = (b.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3, 4))
            for lo, hi in _chunks(np.diff(bounds), pack):
                some = data[bounds[lo]:bounds[hi]]
                if x is None or len(some) >= len(x.up):
                    x, y = (Roller(base, seed, max(pack, len(some))) for base, seed in ((0x5851F42D4C957F2D, 11), (0xDA942042E4DD58B5, 13)))
                at = every(bounds[lo:hi] - bounds[lo], n[lo:hi])
                of = np.repeat(np.arange(lo, hi), n[lo:hi])
                hashes = []
                for roller in (x, y):
                    roller.load(some)
                    hashes.append(roller.of(at, at + length).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*hashes, docs[of], rows[of], starts[of] + at - (bounds[of] - bounds[lo]))],
                    names=["a", "b", "doc", "row", "start"])
    return run


def _rest(length: int, pack: int = PACK):
    """(doc_id, n_bytes, body, new) -> what is left of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, (start, size) = _lists(b.column(3))
            lengths = b.column(1).to_numpy()
            texts = _unpack(b.column(2))
            for lo, hi in _chunks(lengths, pack):
                data = np.frombuffer(b"".join([next(texts) for _ in range(lo, hi)]), np.uint8)
                bounds = np.append(0, np.cumsum(lengths[lo:hi]))
                at, closed = slice(cuts[lo], cuts[hi]), bounds[:-1] + np.maximum(lengths[lo:hi] - (length - 1), 0)
                new = start[at] + np.repeat(bounds[:-1], np.diff(cuts[lo:hi + 1]))
                # Runs of starts that are not old: new ones, and a text's last bytes, where no string starts.
                begin, end = np.append(new, closed), np.append(new + size[at], bounds[1:])
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.append(0, np.maximum.accumulate(end[order]))
                old = np.flatnonzero(begin > end[:-1])
                # A byte goes when one of the last `length` starts is old.
                begin, end = end[old], begin[old] + (length - 1)
                text = np.searchsorted(bounds, begin, side="right") - 1
                opens = np.append(True, (begin[1:] > end[:-1]) | (text[1:] != text[:-1]))[:len(old)]
                begin, end, text = begin[opens], end[np.append(opens[1:], True)[:len(old)]], text[opens]
                removed = np.diff(np.append(0, np.cumsum(end - begin))[np.searchsorted(text, np.arange(hi - lo + 1))])
                spans = np.bincount(text, minlength=hi - lo)
                turns = np.diff(np.concatenate([[0], np.stack([begin, end], 1).ravel(), [len(data)]]))
                left = data[np.repeat(np.arange(len(turns)) % 2 == 0, turns)] if len(old) else data
                kept = _binary(bounds - np.append(0, np.cumsum(removed)), left)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(removed), pa.array(spans),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in kept]), kept],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE, block: int = BLOCK,
                   shard: int = SHARD, hot: int = HOT, memory: int | None = None, base: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept), kept being the remaining bytes.

    Texts are UTF-8 bytes; null counts as empty; texts shorter than ``length``
    bytes lose nothing. Strings are judged on the input. A null doc_id comes
    before all others; rows that repeat a doc_id are documents of their own, in
    a fixed order. doc_id is an integer. No rows give no rows.
    """
    spark = docs.sparkSession
    table = saved(doc_texts(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
                  .mapInArrow(_pack, "row long, doc_id long, n_bytes long, body binary"), "repeat-texts")
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")
    cut = table.filter(F.col("n_bytes") >= length).select("row", doc, "body").mapInArrow(
        _cut(length, gram, piece, block), "gram long, whole long, doc long, row long, start long, n int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = saved(cut.repartition(parts, "gram").sortWithinPartitions("gram", "whole", "doc", "row", "start").mapInArrow(
        _first, "gram long, doc long, row long, start long, n int, many boolean").select(
        F.when(F.col("many"), F.col("gram")).alias("gram"), "row", "start", "n"), "repeat-first")
    alone = first.filter("gram IS NULL").select("row", "start", "n")
    open_ = first.filter("gram IS NOT NULL")
    # Saved, so that the join below is a plain one whose hot grams Spark can split.
    busy = saved(open_.groupBy("gram").count().filter(F.col("count") > hot).select("gram", F.lit(True).alias("hot")), "repeat-hot")
    size = open_.agg(F.sum(F.col("n") + length)).first()[0]
    new = alone
    if size:
        want = open_.join(busy, "gram", "left").groupBy("row").agg(F.collect_list(F.struct(
            "gram", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want"))
        sliced = saved(table.select("row", doc, "body").join(want, "row").select("row", "doc", "body", "want").mapInArrow(
            _slices(length), "gram long, doc long, row long, start long, n int, hot boolean, part binary"), "repeat-parts")
        shards = max(1, -(-size // shard))
        settled = sliced.filter(~F.col("hot")).repartition(shards, "gram").sortWithinPartitions(
            "doc", "row", "start").mapInArrow(_sort_shard(length, memory, base), "row long, start long, n int")
        single = (sliced.filter("hot").mapInArrow(_strings(length), "a long, b long, doc long, row long, start long")
                  .groupBy("a", "b").agg(F.min(F.struct("doc", "row", "start")).alias("m"))
                  .select("m.row", "m.start", F.lit(1).alias("n")))
        new = alone.unionByName(settled).unionByName(single)
    runs = new.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("new"))
    return table.join(runs, "row", "left").select("doc_id", "n_bytes", "body", "new").mapInArrow(
        _rest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
