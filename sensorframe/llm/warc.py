"""WARC archives: written from a table of pages, read back in parallel and verified.

Writing: of pages with equal payloads one is stored, the others become revisit
records that name it.

Reading: an archive is split anywhere, so a task cannot know whether a line that
looks like the start of a record is one or lies inside a payload. Every task cuts
its part of a file (a block) at such lines, and every one with a readable header
is a candidate with the offset at which its successor must start. Inside a block,
candidates are followed to the first offset outside it; what remains are links
between blocks, a few per block. Pointer jumping over these links from offset 0 of
every file finds the first true record of every block, from where the chain is
followed inside the block. Candidates that the chain does not reach are payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sensorframe.session import work_dir

from .common import saved

#: Bytes from which equal payloads are stored once.
LEAST = 1000
#: Bits of the filter that tells which payloads can have an equal; fixed, whatever the table's size.
FILTER_BITS = 1 << 23

# Fixed values of the format.
MAGIC = b"WARC/1."
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PLAIN, CANDIDATE, OPEN = 0, 1, 2
_PIECE = ("path string, file long, block long, rel long, n long, kind int, head_len long, length long, fields map<string,string>, "
          "whole boolean, payload_at long, payload_bytes long, payload_sha1 string, body binary")


# --- writing ---------------------------------------------------------------------------------

def _field(value: Column) -> Column:
    """A header value: control characters, which would end the line, as spaces."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def _filter_of(keys: DataFrame, spark: SparkSession):
    """A broadcast bitmap of ``FILTER_BITS`` bits of the ``key`` column's hashes."""
    words = (keys.select(F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("slot"))
             .groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect())
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in words:
        bits[r.word] = r.bits
    return spark.sparkContext.broadcast(bits)


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_sha1, best_id, revisit) of every page:
    of equal payloads of ``least`` bytes or more the largest page_id is stored and
    the others revisit it.

    Null html is an empty payload. A null page_id is smaller than any other. Rows that
    repeat the stored page with its payload are stored too, and so are all rows
    of a payload whose page_ids are all null. Only rows whose payload can have an
    equal, by a filter of fixed size over the payloads met more than once, are
    joined to the groups; the others' texts are not shuffled.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "key": F.sha2(F.col("html").cast("binary"), 256)})
    groups = saved(rows.filter(F.col("payload_bytes") >= least).groupBy("key", "payload_bytes")
                   .agg(F.max("page_id").alias("best_id"), F.count(F.lit(1)).alias("copies"))
                   .filter("copies > 1"), "warc-groups")
    held = _filter_of(groups, spark)

    @F.pandas_udf("boolean")
    def can_repeat(slot: pd.Series) -> pd.Series:
        s = slot.to_numpy(np.int64)
        return pd.Series(((held.value[s >> 6] >> (s & 63)) & 1).astype(bool))

    rows = rows.withColumn("may", (F.col("payload_bytes") >= least) & can_repeat(
        F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))))
    alone = rows.filter(~F.col("may")).withColumn("best_id", F.lit(None).cast("long")).withColumn("copies", F.lit(1).cast("long"))
    some = rows.filter("may").join(groups, ["key", "payload_bytes"], "left")
    both = alone.unionByName(some)
    return both.select("page_id", "url", "html", "payload_bytes", F.sha1(F.col("html").cast("binary")).alias("payload_sha1"),
                       "best_id", (F.coalesce("copies", F.lit(1)).__gt__(1) & ~F.col("page_id").eqNullSafe(F.col("best_id"))).alias("revisit"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html; other columns are not
    looked at) to uncompressed archives in ``path``, one per task. Blocks
    are HTTP responses whose body is the html in UTF-8; a revisit keeps the
    HTTP header only. Control characters in urls become spaces."""
    t = typed(pages, least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    revisit = lambda c: F.when(F.col("revisit"), c)  # noqa: E731  null otherwise, and skipped by concat_ws
    head = F.concat_ws(
        "\r\n", F.lit(VERSION),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _field(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))),
        revisit(line("WARC-Refers-To", record_id(F.col("best_id")))), revisit(line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")))
    t = t.withColumn("block", block)
    t.select(F.concat(head, F.lit(END), "block").alias("value")).write.option("lineSep", END).text(path)


# --- reading ---------------------------------------------------------------------------------

def parse_head(body: bytes) -> tuple[int, int, dict[str, str]] | None | bool:
    """(bytes of the header with its empty line, Content-Length, fields by lower-case name);
    None while the empty line is missing, False when it is no header."""
    end = body.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields: dict[str, str] = {}
    name = None
    for line in body[:end].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        left, colon, value = line.partition(b":")
        if not colon:
            return False
        name = left.strip().lower().decode("utf-8", "replace")
        fields[name] = value.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    return (end + 4, int(n), fields) if n.isascii() and n.isdigit() else False


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, any other block as a whole."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _cut(keep_all: bool):
    """Lines (file, block, line) in file order -> the pieces of every block: one for each
    line that looks like a record's start, and what stands before the first.

    The body stays with a piece that is no whole record or that an earlier
    candidate of the block may contain (with all pieces if ``keep_all``)."""
    def piece(at, rel, lines, covered):
        body = b"\n".join(lines) + b"\n"
        kind, head_len, length, fields, whole, place, size, sha = PLAIN, None, None, None, False, None, None, None
        if body.startswith(MAGIC):
            head = parse_head(body)
            kind = OPEN if head is None else CANDIDATE if head else PLAIN
            if head:
                head_len, length, fields = head
                whole = head_len + length + 4 <= len(body)
                if whole:
                    payload = payload_of(fields, body[head_len:head_len + length])
                    place, size, sha = head_len + length - len(payload), len(payload), hashlib.sha1(payload).hexdigest()
        keep = keep_all or not whole or rel < covered
        succ = rel + head_len + length + 4 if kind == CANDIDATE else 0
        return (at[0], xxhash.xxh64_intdigest(at[0].encode()) >> 1, at[1], rel, len(body), kind, head_len, length, list(fields.items()) if fields is not None else None, whole, place, size, sha,
                body if keep else None), max(covered, succ)

    schema = pa.schema([("path", pa.string()), ("file", pa.int64()), ("block", pa.int64()), ("rel", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()),
                        ("head_len", pa.int64()), ("length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
                        ("whole", pa.bool_()), ("payload_at", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel, lines, covered, out, held = None, 0, [], 0, [], 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for f, k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                new = at is None or k != at[1] or f != at[0]
                if lines and (new or line.startswith(MAGIC)):
                    row, covered = piece(at, rel, lines, covered)
                    out.append(row)
                    rel, lines, held = rel + row[4], [], held + len(row[-1] or b"")
                if new:
                    at, rel, covered = (f, k), 0, 0
                lines.append(line)
            if len(out) >= 10_000 or held > 16_000_000:
                yield table()
                out, held = [], 0
        if lines:
            out.append(piece(at, rel, lines, covered)[0])
        if out:
            yield table()
    return run


def pieces_of(spark: SparkSession, path: str, keep_all: bool) -> DataFrame:
    """The pieces of all blocks of the archives in ``path``, with their offsets: start is the
    piece's place in its file, which goes by a number (of the path's hash)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))
    pieces = saved(lines.mapInArrow(_cut(keep_all), _PIECE), "warc-pieces")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum("n").alias("bytes")).select(
        "file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    return pieces.join(saved(blocks, "warc-blocks"), ["file", "block"]).withColumn("start", F.col("base") + F.col("rel")).drop("base", "rel")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, start, end, body) -> the same with what the header says."""
    for b in batches:
        got = [parse_head(x) for x in b.column(4).to_pylist()]
        part = lambda i, kind: pa.array([list(g[i].items()) if g and i == 2 else g[i] if g else None for g in got], kind)
        yield pa.RecordBatch.from_arrays([
            *b.columns, pa.array([OPEN if g is None else CANDIDATE if g else PLAIN for g in got], pa.int32()), part(0, pa.int64()),
            part(1, pa.int64()), part(2, pa.map_(pa.string(), pa.string()))],
            names=["file", "block", "start", "end", "body", "kind", "head_len", "length", "fields"])


def _candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, start, head_len, length, fields, succ) of all readable headers. A
    header that reaches over the end of its block goes on in the following pieces,
    one after another, until its empty line is found."""
    names = ["file", "block", "start", "head_len", "length", "fields"]
    found = pieces.filter(F.col("kind") == CANDIDATE).select(*names)
    left = pieces.filter(F.col("kind") == OPEN).select("file", "block", "start", (F.col("start") + F.col("n")).alias("end"), "body")
    if not left.isEmpty():
        after = pieces.filter(F.col("kind") == PLAIN).select("file", F.col("start").alias("end"), "n", F.col("body").alias("more"))
        while True:
            # At most one header for each block.
            read = saved(left.join(after, ["file", "end"]).select(
                "file", "block", "start", (F.col("end") + F.col("n")).alias("end"), F.concat("body", "more").alias("body"))
                .mapInArrow(_heads, "file long, block long, start long, end long, body binary, kind int, head_len long, length long, "
                            "fields map<string,string>"), "warc-heads")
            found = found.unionByName(read.filter(F.col("kind") == CANDIDATE).select(*names))
            left = read.filter(F.col("kind") == OPEN).select("file", "block", "start", "end", "body")
            if left.isEmpty():
                break
    return saved(found.withColumn("succ", F.col("start") + F.col("head_len") + F.col("length") + 4), "warc-candidates")


def _exits(block: pd.DataFrame) -> pd.DataFrame:
    """The first offset outside the block that every candidate's chain comes to."""
    block = block.sort_values("start", ascending=False)
    out: dict[int, int] = {}
    for start, succ in zip(block["start"].tolist(), block["succ"].tolist(), strict=True):
        out[start] = out.get(succ, succ)
    return block.assign(exit=[out[s] for s in block["start"].tolist()])[["file", "block", "start", "exit"]]


def _follow(block: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the chain from the block's entry passes."""
    succ = dict(zip(block["start"].tolist(), block["succ"].tolist(), strict=True))
    at, true = int(block["entry"].iloc[0]), []
    while at in succ:
        true.append(at)
        at = succ[at]
    return block[block["start"].isin(true)][["file", "block", "start"]]


def true_starts(candidates: DataFrame) -> DataFrame:
    """(file, block, start) of the candidates on the chain from offset 0 of their file."""
    links = candidates.select("file", "block", "start", "succ")
    exits = saved(links.groupBy("file", "block").applyInPandas(_exits, "file long, block long, start long, exit long"), "warc-exits")
    targets = exits.select("file", F.col("exit").alias("start")).distinct()
    nodes = saved(exits.filter("start = 0").unionByName(exits.filter("start > 0").join(targets, ["file", "start"], "left_semi")),
                  "warc-links")
    jump = nodes.select("file", "start", "exit")
    reached = nodes.filter("start = 0").select("file", "start")
    while True:
        # Twice as far a round: whoever is reached passes it on to where its pointer leads, then every pointer doubles.
        reached = saved(reached.unionByName(reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
                                            .join(nodes, ["file", "start"], "left_semi")), "warc-reached")
        on = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("next"))
        jump = saved(jump.join(on, ["file", "exit"]).select("file", "start", F.col("next").alias("exit")), "warc-jump")
        if jump.isEmpty():
            break
    entries = nodes.join(reached.distinct(), ["file", "start"], "left_semi").select("file", "block", F.col("start").alias("entry"))
    return saved(links.join(entries, ["file", "block"]).groupBy("file", "block").applyInPandas(
        _follow, "file long, block long, start long"), "warc-true")


def _assemble(record: pd.DataFrame) -> pd.DataFrame:
    """One record from its pieces (start, body), the header's facts on each."""
    record = record.sort_values("start")
    one = record.iloc[0]
    fields = dict(one["fields"])
    data = b"".join(bytes(x) for x in record["body"])
    block = data[int(one["head_len"]):int(one["head_len"]) + int(one["length"])]
    payload = payload_of(fields, block)
    return pd.DataFrame({"file": [one["file"]], "offset": [one["offset"]], "payload_bytes": [len(payload)],
                         "payload_sha1": [hashlib.sha1(payload).hexdigest()], "payload": [payload]})


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(file, offset, length, type, record_id, target_uri, fields, payload_bytes, payload_sha1[, payload])
    of every record on the chains of the archives in ``path``.

    Bytes and digest are those of the payload as stored (of a revisit: of
    none). Reading a file stops where no record starts; a last record that is cut off is
    left out, and so is a file that does not begin with a record. Empty files and
    folders of none give no rows. Archives must be uncompressed.
    """
    pieces = pieces_of(spark, path, keep_all=payloads)
    paths = saved(pieces.groupBy("file").agg(F.min("path").alias("path"), F.max("path").alias("other")), "warc-paths")
    if not paths.filter("path <> other").isEmpty():
        raise ValueError("two archives' paths have one hash; rename one")
    pieces = pieces.drop("path")
    candidates = _candidates(pieces)
    true = true_starts(candidates)
    size = pieces.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("size"))
    records = (candidates.join(true, ["file", "block", "start"], "left_semi").join(size, "file").filter("succ <= size")
               .drop("size", "block"))
    # The record of every piece: the last true start in its block, else in the blocks before.
    flags = pieces.select("file", "block", "start", "whole").join(true.withColumn("is", F.lit(True)), ["file", "block", "start"], "left")
    place = flags.withColumn("own", F.last(F.when(F.col("is"), F.col("start")), ignorenulls=True).over(
        W.partitionBy("file", "block").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    ends = true.groupBy("file", "block").agg(F.max("start").alias("last"))
    carry = flags.select("file", "block").distinct().join(ends, ["file", "block"], "left").select("file", "block", F.max("last").over(
        W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    place = saved(place.join(carry, ["file", "block"]).select(
        "file", "start", F.coalesce("own", "carry").alias("offset"), (F.coalesce("is", F.lit(False)) & F.col("whole")).alias("whole"))
        .filter("offset IS NOT NULL"), "warc-places")
    parts = place.join(place.filter("whole").select("file", "offset"), ["file", "offset"], "left_anti").select("file", "start", "offset")
    facts = ["payload_bytes", "payload_sha1"] + ["payload"] * payloads
    own = pieces.join(place.filter("whole").select("file", "start"), ["file", "start"], "left_semi")
    single = own.select("file", F.col("start").alias("offset"), *facts[:2],
                        *([F.expr("substring(body, int(payload_at + 1), int(payload_bytes))").alias("payload")] if payloads else []))
    split = saved(pieces.select("file", "start", "n", "body").join(parts, ["file", "start"]), "warc-parts")
    heads = records.select("file", F.col("start").alias("offset"), "head_len", "length", "fields", "succ")
    # Bytes after the last record of a file belong to no record, though they follow one.
    split = split.join(heads, ["file", "offset"]).filter("start < succ")
    if not payloads and not split.filter("body IS NULL").isEmpty():
        return read_archives(spark, path, payloads=True).drop("payload")  # whole look-alikes inside a payload that spans blocks
    whole = split.groupBy("file", "offset").applyInPandas(
        _assemble, "file long, offset long, payload_bytes long, payload_sha1 string, payload binary").select("file", "offset", *facts)
    field = lambda name: F.col("fields")[name]
    return records.withColumnRenamed("start", "offset").join(single.unionByName(whole), ["file", "offset"]).join(
        paths.select("file", "path"), "file").select(F.col("path").alias("file"), "offset", (F.col("head_len") + F.col("length") + 4).alias("length"), field("warc-type").alias("type"),
        field("warc-record-id").alias("record_id"), field("warc-target-uri").alias("target_uri"), "fields", *facts)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes and payload_sha1 of revisits taken from the record they
    refer to (null where no response has that id). Of responses with one id any has them,
    as ids name payloads."""
    got = saved(records.select("file", "offset", "type", "record_id", "fields", "payload_bytes", "payload_sha1"), "warc-records")
    # Saved, so that the join below is a plain one whose large groups Spark can split.
    named = saved(got.filter("type = 'response'").groupBy(F.col("record_id").alias("to")).agg(
        F.min(F.struct("payload_bytes", "payload_sha1")).alias("of")), "warc-named")
    again = got.filter("type = 'revisit'").withColumn("to", F.col("fields")["warc-refers-to"])
    again = again.join(named, "to", "left").withColumns({"payload_bytes": F.col("of.payload_bytes"), "payload_sha1": F.col("of.payload_sha1")})
    return got.filter("type <> 'revisit'").unionByName(again.select(got.columns))


def archive_folder(spark: SparkSession) -> str:
    return work_dir(spark, "llm-warc")
