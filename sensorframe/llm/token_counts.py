"""Token counts without token ids.

A text is cut into pre-tokens as the tokenizer does before its merges. Blocks
of documents are turned into their distinct pre-tokens, dealt into buckets by
hash, and the documents and frequencies of each. The pre-tokens alone go to
their buckets, where the pieces of every distinct pre-token of the corpus are
counted once by the library; the numbers of pieces go back to the blocks, are
joined to the frequencies and summed by document. All of these travel packed.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, saved

#: Characters of text that are inverted together; bounds a task's memory.
BLOCK_CHARS = 6_000_000
#: Largest offset of a document in its block.
SHORT = 32_767
#: Buckets of pre-tokens for each shuffle partition.
BUCKETS = 2
BLOCK_COLUMNS = ["base", "bucket", "pretokens", "doc_ids", "sizes", "special", "words", "docs", "times"]
#: Last character of the part of Unicode that the fast path cuts by itself.
LATIN = 0x24F

# Fixed values of the tokenizer: the strings that are tokens of their own, and the pattern of its pre-tokens.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _latin_pattern() -> re.Pattern:
    """``PRETOKEN`` over the characters up to ``LATIN``, for the plain ``re`` engine."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "s": []}
    for c in map(chr, range(LATIN + 1)):
        kind = "s" if regex.match(r"\s", c) else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind].append(re.escape(c))
    letter, number, space = ("".join(kinds[k]) for k in "LNs")
    return re.compile(PRETOKEN.replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{number}]").replace(
        r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"))


class PreTokens:
    """Cuts texts into the pre-tokens that the library's tokenizer file
    makes; text beyond ``LATIN`` goes through the library's own normaliser and
    splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.fast = _latin_pattern()
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN)}]")
        self.special = re.compile("|".join(map(re.escape, SPECIALS)))
        self.bytes_of = {c: b for b, c in _byte_letters().items()}

    def cut(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            # Two characters up to LATIN have lower-case forms outside the plain mapping; both agree with str.lower.
            return self.fast.findall(unicodedata.normalize("NFC", text).lower())
        norm = self.lib.normalizer.normalize_str(text)
        return [bytes(self.bytes_of[c] for c in piece).decode("utf-8", "replace")
                for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)]

    def count(self, text: str) -> tuple[Counter, int]:
        """(frequencies of pre-tokens, number of special strings)."""
        if "<|" not in text:
            return Counter(self.cut(text)), 0
        parts = self.special.split(text)
        total: Counter = Counter()
        for part in parts:
            total.update(self.cut(part))
        return total, len(parts) - 1


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers write the 256 bytes: visible
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in seen}
    out.update({b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in out)})
    return out


def _pack(values: np.ndarray) -> bytes:
    """An array of integers, all lowest bytes first, compressed."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _invert(path: str, block_chars: int, buckets: int):
    """(doc_id, n_bytes, text) -> for every block of documents one row for each bucket of its distinct
    pre-tokens, and one without a bucket that holds the documents' facts and, for the pre-tokens in
    the order of the buckets, the documents and frequencies. Both kinds are made here, once,
    so that they agree whatever order the input comes in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        base = TaskContext.get().partitionId() << 40

        def empty():
            index: defaultdict = defaultdict()
            index.default_factory = index.__len__
            return index, [], [], [], array("i"), array("H"), array("I"), 0

        index, ids, sizes, special, word, doc, times, chars = empty()

        def block():
            words, pack = np.array([*index, None], object)[:-1], zstandard.ZstdCompressor(level=1)
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in index), np.int32, len(index))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            at = place[np.array(word, np.int32)]
            line = np.argsort(at, kind="stable")
            docs = np.array(doc, np.uint16)[line]
            full, starts = np.unique(bucket[order], return_index=True)
            packed = [pack.compress("\n".join(x).encode("utf-8", "surrogatepass")) for x in np.split(words[order], starts[1:])] if len(full) else []
            blank = [None] * len(full)
            one = lambda x, kind: pa.array([*blank, x], kind)
            return pa.RecordBatch.from_arrays([
                pa.array([base] * (len(full) + 1), pa.int64()), pa.array([*full.tolist(), None], pa.int32()),
                pa.array([*packed, None], pa.binary()),
                one(ids, pa.list_(pa.int64())), one(sizes, pa.list_(pa.int64())), one(special, pa.list_(pa.int64())),
                one(_pack(np.bincount(at, minlength=len(order)).astype(np.uint32)), pa.binary()),
                # Steps from one document to the next; they wrap around where the next pre-token begins.
                one(_pack(np.diff(docs, prepend=np.uint16(0))), pa.binary()),
                one(_pack(np.array(times, np.uint32)[line]), pa.binary())], names=BLOCK_COLUMNS)

        for batch in batches:
            texts = batch.column(2)
            for i, (d, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = texts[i].as_py()
                counted, specials = cutter.count(text)
                word.extend(map(index.__getitem__, counted))
                doc.extend([len(ids)] * len(counted))
                times.extend(counted.values())
                ids.append(d)
                sizes.append(size)
                special.append(specials)
                chars += len(text)
                if chars >= block_chars or len(ids) > SHORT:
                    yield block()
                    base += len(ids)
                    index, ids, sizes, special, word, doc, times, chars = empty()
        if ids:
            yield block()
    return run


def _pieces(path: str):
    """Numbers of pieces of the pre-tokens of every (base, bucket). Rows come bucket by bucket, so that
    the library sees every distinct pre-token once and only one bucket's are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        lib, unpack = Tokenizer.from_file(path), zstandard.ZstdDecompressor()
        known, current = {}, None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != current:
                    known, current = {}, bucket
                words = unpack.decompress(packed.as_py()).decode("utf-8", "surrogatepass").split("\n")
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, (len(e.ids) for e in lib.encode_batch(fresh, add_special_tokens=False)), strict=True))
                out.append(_pack(np.fromiter(map(known.__getitem__, words), np.uint32, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             names=["base", "bucket", "pieces"])
    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_ids, sizes, special, words, docs, times, pieces) of a block -> (doc_id, n_bytes, n_tokens)."""
    for batch in batches:
        for ids, sizes, special, words, docs, times, pieces in zip(*batch.columns, strict=True):
            each = np.concatenate([np.empty(0, np.uint32), *(_unpack(x, np.uint32) for x in pieces.as_py() or ())])
            tokens = np.repeat(each, _unpack(words.as_py(), np.uint32)).astype(np.int64) * _unpack(times.as_py(), np.uint32)
            total = np.array(special.as_py(), np.int64)
            np.add.at(total, np.cumsum(_unpack(docs.as_py(), np.uint16), dtype=np.uint16), tokens)
            yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_tokens, over_limit).

    ``path`` is the tokenizer file on every executor. Null texts count as empty
    (no bytes, no tokens); repeated rows are counted one by one; no rows
    give no rows. ``over_limit``: more than ``limit`` tokens.
    """
    rows = doc_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = saved(rows.mapInArrow(
        _invert(path, block_chars, BUCKETS * parts),
        "base long, bucket int, pretokens binary, doc_ids array<long>, sizes array<long>, special array<long>, "
        "words binary, docs binary, times binary"), "pretokens")
    pieces = (blocks.filter("bucket IS NOT NULL").select("base", "bucket", "pretokens")
              .repartition(parts, "bucket").sortWithinPartitions("bucket")
              .mapInArrow(_pieces(path), "base long, bucket int, pieces binary"))
    by_block = pieces.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("bucket", "pieces")))["pieces"].alias("pieces"))
    counted = (blocks.filter("bucket IS NULL").drop("bucket", "pretokens").join(by_block, "base", "left")
               .select("doc_ids", "sizes", "special", "words", "docs", "times", "pieces")
               .mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
