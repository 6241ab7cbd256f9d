"""Chat formatting by quotation linking.

Messages that quote others with leading ``>`` signs are parsed into their own
text and quoted passages of every level. Normalised passages are hashed and joined to
the latest earlier message with the same passage of its own; the links give
every message its parent, and messages without quotes, ordered by reply, form the
conversations.

A passage that very many messages share is looked up by time bucket: the last
message of every bucket is aggregated first, so no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

#: Equal parts of the time span by which lookups of one passage are dealt.
TIME_BUCKETS = 4096
#: Marks of one quote level at the start of a line.
QUOTE = r"^(?:[ \t]*>)+[ \t]?"


def _normal(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\x0b\x0c]+", " "))


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), F.length(text).alias("n"))


def parse(messages: DataFrame) -> DataFrame:
    """(msg_id, sent, author, own, runs): own text without quoted lines, and
    the quoted passages in order, each (level, lines) for a run of lines of one level.

    Levels are numbers of ``>`` signs, with spaces or tabs between them; quoted
    lines without text are left out and do not end a run."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r", -1)
    marked = F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, QUOTE, "").alias("line")))
    p = messages.select("msg_id", "sent", "author", marked.alias("lines"))
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))
    quoted = F.filter("lines", lambda x: (x["level"] > 0) & (F.trim(x["line"]) != ""))
    # A new run starts where the level differs from the line before.
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("quoted"), F.lit(1))), lambda i: (
        (i <= F.size("quoted")) & ((i == 1) | (F.try_element_at("quoted", i)["level"]
                                              != F.try_element_at("quoted", F.greatest(i - 1, F.lit(1)))["level"]))))
    p = p.select("msg_id", "sent", "author", own.alias("own"), quoted.alias("quoted")).withColumn("starts", starts)
    runs = F.transform("starts", lambda s, k: F.struct(
        F.element_at("quoted", s)["level"].alias("level"),
        F.transform(F.slice("quoted", s, F.coalesce(F.try_element_at("starts", k + 2), F.size("quoted") + 1) - s),
                    lambda x: x["line"]).alias("lines")))
    return p.select("msg_id", "sent", "author", "own", runs.alias("runs"))


def _latest_before(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """``quotes`` (key, sent, msg_id, ...) with ``found``, the id of the latest
    message of ``originals`` (key, sent, msg_id) that has the key and comes
    before by (sent, msg_id); quotes without one are left out."""
    span = originals.agg(F.min("sent").alias("lo"), F.max("sent").alias("hi")).first()
    lo, hi = (span["lo"] or 0), (span["hi"] or 0)
    width = max((hi - lo + TIME_BUCKETS) // TIME_BUCKETS, 1)
    bucket = F.floor((F.col("sent") - F.lit(lo)) / F.lit(width)).cast("long")
    q, o = quotes.withColumn("bucket", bucket), originals.withColumn("bucket", bucket)
    at = F.struct("sent", "msg_id")
    lasts = o.groupBy("key", "bucket").agg(F.max(at).alias("last"))
    # Cells with a quote or an original; each learns the last original of earlier cells.
    cells = (lasts.select("key", "bucket", "last").unionByName(
        q.select("key", "bucket", F.lit(None).cast(lasts.schema["last"].dataType).alias("last")).distinct())
        .groupBy("key", "bucket").agg(F.max("last").alias("last")))
    earlier = F.max("last").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("key", "bucket", earlier.alias("carried"))
    # Inside a cell: quotes and originals in time order.
    names = [c for c in quotes.columns if c not in ("key", "sent", "msg_id")]
    both = q.select("key", "bucket", "sent", "msg_id", F.lit(True).alias("asks"), *names).unionByName(
        o.select("key", "bucket", "sent", "msg_id", F.lit(False).alias("asks")), allowMissingColumns=True)
    near = F.max(F.when(~F.col("asks"), at)).over(
        W.partitionBy("key", "bucket").orderBy("sent", "msg_id", F.col("asks").desc())
        .rowsBetween(W.unboundedPreceding, -1))
    asked = both.withColumn("near", near).filter("asks").drop("asks")
    return (asked.join(cells, ["key", "bucket"]).withColumn("found", F.coalesce("near", "carried")["msg_id"])
            .filter("found IS NOT NULL").drop("bucket", "near", "carried"))


def link(parsed: DataFrame) -> DataFrame:
    """(msg_id, run, level, found, weight): for every quoted passage the message
    it comes from. A passage that equals a whole own text decides;
    otherwise most of its lines do, then the later message."""
    own = parsed.filter("own <> ''")
    pieces = F.array_distinct(F.concat(F.array(_normal(F.col("own"))), F.transform(F.split("own", "\n"), _normal)))
    originals = (own.select("sent", "msg_id", F.explode(pieces).alias("piece")).filter("piece <> ''")
                 .select(_key(F.col("piece")).alias("key"), "sent", "msg_id"))
    runs = parsed.select("msg_id", "sent", F.posexplode("runs").alias("run", "r"))
    whole = runs.select("msg_id", "sent", "run", F.col("r.level").alias("level"), F.lit(1_000_000).cast("long").alias("weight"),
                        _normal(F.array_join("r.lines", "\n")).alias("piece"))
    lines = runs.select("msg_id", "sent", "run", F.col("r.level").alias("level"), F.lit(1).cast("long").alias("weight"),
                        F.explode(F.transform("r.lines", _normal)).alias("piece"))
    quotes = whole.unionByName(lines).filter("piece <> ''").groupBy(
        "msg_id", "sent", "run", "level", _key(F.col("piece")).alias("key")).agg(F.sum("weight").alias("weight"))
    found = _latest_before(quotes, originals)
    votes = found.groupBy("msg_id", "run", "level", "found").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct("weight", "found")).alias("best")
    return votes.groupBy("msg_id", "run", "level").agg(best).select(
        "msg_id", "run", "level", F.col("best.found").alias("found"), F.col("best.weight").alias("weight"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: (conversation, turn, msg_id, parent_id, depth,
    author, text, n_quotes, n_linked).

    ``messages`` has (msg_id, sent, author, text): ids are unique, ``sent`` (long)
    orders them, ties by msg_id. The parent is the source of the first linked
    passage of the lowest level; since a parent is always earlier, replies can't
    form a circle. conversation is the id of the first message; turn counts its
    messages from 0 in time order, so that every message follows its parent. text is
    the message without quotes. Null texts count as empty; rows with a null
    msg_id or sent are left out; of rows that repeat an id the first by
    (sent, author, text) counts. No rows give no rows.
    """
    one = messages.filter("msg_id IS NOT NULL AND sent IS NOT NULL").groupBy("msg_id").agg(
        F.min(F.struct("sent", "author", "text")).alias("m")).select("msg_id", "m.*")
    parsed = saved(parse(one), "quote-parsed")
    links = saved(link(parsed), "quote-links")
    parents = links.groupBy("msg_id").agg(
        F.min(F.struct("level", "run", "found"))["found"].alias("parent_id"), F.count(F.lit(1)).alias("n_linked"))
    rows = saved(parsed.select("msg_id", "sent").join(parents, "msg_id", "left").select(
        "msg_id", "sent", "parent_id", F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "quote-parents")
    # Ancestors by doubling: a row is known once its ancestor is a first message, and only the others go on.
    depth = lambda n: F.lit(n).cast("long").alias("depth")
    known = rows.filter("parent_id IS NULL").select("msg_id", F.col("msg_id").alias("up"), depth(0))
    left = rows.filter("parent_id IS NOT NULL").select("msg_id", F.col("parent_id").alias("up"), depth(1))
    while not left.isEmpty():
        above = known.withColumn("ends", F.lit(True)).unionByName(left.withColumn("ends", F.lit(False))).select(
            F.col("msg_id").alias("a"), F.col("up").alias("up2"), F.col("depth").alias("d2"), "ends")
        after = saved(left.join(above, F.col("up") == F.col("a")).select(
            "msg_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), "ends"), "quote-roots")
        known = known.unionByName(after.filter("ends").drop("ends"))
        left = after.filter("NOT ends").drop("ends")
    placed = rows.join(known, "msg_id").select("msg_id", "sent", "parent_id", "n_linked", F.col("up").alias("conversation"), "depth")
    # turn: messages of earlier time buckets, then the rank inside the bucket.
    span = rows.agg(F.min("sent").alias("lo"), F.max("sent").alias("hi")).first()
    width = max(((span["hi"] or 0) - (span["lo"] or 0) + TIME_BUCKETS) // TIME_BUCKETS, 1)
    placed = saved(placed.withColumn("bucket", F.floor((F.col("sent") - F.lit(span["lo"] or 0)) / width).cast("long")), "quote-placed")
    cells = placed.groupBy("conversation", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("conversation", "bucket", F.coalesce(F.sum("n").over(
        W.partitionBy("conversation").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("conversation", "bucket").orderBy("sent", "msg_id"))
    turns = placed.withColumn("rank", rank).join(cells, ["conversation", "bucket"]).select(
        "msg_id", "conversation", (F.col("before") + F.col("rank") - 1).alias("turn"), "parent_id", "depth", "n_linked")
    return turns.join(parsed, "msg_id").select(
        "conversation", "turn", "msg_id", "parent_id", "depth", "author", F.col("own").alias("text"),
        F.size("runs").cast("long").alias("n_quotes"), "n_linked")
