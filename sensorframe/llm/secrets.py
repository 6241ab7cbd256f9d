"""Secret scan: fixed patterns plus character Markov models.

The patterns find assigned credentials, access keys and long hexadecimal runs.
Two first-order character models, one of random strings and one of ordinary
identifiers, then score every other long token of credential characters; a token
that the random model explains better by ``MIN_LLR`` per character becomes a
span of its own. The models are trained here from labelled samples: the
values that the patterns found are the random class, tokens made of letters
only are the ordinary class. All counts cover all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, saved

# The three base patterns and the least length of what they find.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more: the runs are maximal
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: Tokens looked at by the models, the smallest gain per character (nats) and the added count of a pair.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_LLR = 0.25
SMOOTH = 0.5
#: Symbols of the models: every character is one of these, or "?".
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-^"


#: Running values are made piece by piece of so many elements, so that a step appends to a short array.
PIECE = 64


def running(values: str, start: int, step) -> Column:
    """``step`` (such as a sum) of ``start`` and the elements of an int array up to each, as an array.
    ``values`` names a column, as an expression would be made again for every piece.

    Appending to one array copies it each time; here pieces of ``PIECE`` elements are put
    together one by one, so the work stays in proportion to the length.
    """
    last = lambda a: F.element_at(a, -1)
    count = F.size(values)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / PIECE).cast("int")),
                         lambda p: F.slice(F.col(values), p * PIECE + 1, F.lit(PIECE)))

    def piece(done, part):
        one = F.aggregate(part, F.array(last(last(done))), lambda o, x: F.concat(o, F.array(step(last(o), x))))
        return F.concat(done, F.array(F.slice(one, F.lit(2), F.lit(PIECE))))
    whole = F.aggregate(pieces, F.array(F.array(F.lit(start))), piece)
    return F.when(count > 0, F.slice(F.flatten(whole), F.lit(2), F.greatest(count, F.lit(1)))).otherwise(F.expr("CAST(array() AS array<int>)"))


def cells(text: Column, pattern: str) -> Column:
    """(n, value) per match of a pattern: the characters from the end of the match before, and the
    match. A last element holds the rest of the text and no value."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda gap, v: F.struct((F.length(gap) + F.coalesce(F.length(v), F.lit(0))).alias("n"), v.alias("value")))


def located(cell: str, end: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in code points, end
    exclusive, from the columns of their cells and of the running sums of the cells' ``n``."""
    spans = F.zip_with(cell, end, lambda c, e: F.struct(
        (e - F.length(c["value"])).alias("start"), e.alias("end"), c["value"].alias("value")))
    return F.filter(spans, lambda x: x["value"].isNotNull())


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"),
                                                 x["end"].alias("end"), x["value"].alias("value")))


def _pairs(token: Column) -> Column:
    """The adjacent character pairs of a token, with a start mark."""
    return F.regexp_extract_all(F.concat(F.lit("^"), token), F.lit("(?s)(?=(..))"), F.lit(1))


def base_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, tokens): the spans of the fixed patterns and the
    other long tokens, which overlap none of them.

    Columns that are used twice come from a projection of their own, so that none is made
    again for each use or element; all work is in proportion to a text's length and matches.
    """
    t = doc_texts(docs).withColumn("row", F.monotonically_increasing_id())
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    t = t.select("row", "doc_id", *[cells(F.col("text"), p).alias(k) for k, p in kinds.items()])
    t = t.select("*", *[F.transform(k, lambda c: c["n"]).alias(f"{k}_n") for k in kinds])
    t = t.select("*", *[running(f"{k}_n", 0, lambda a, x: a + x).alias(f"{k}_end") for k in kinds])
    assign = F.filter(located("assign", "assign_end"), lambda x: F.length(
        F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_VALUE)
    t = t.select("row", "doc_id", F.concat(
        _kind(assign, 0), _kind(located("access", "access_end"), 1), _kind(located("hex", "hex_end"), 2)).alias("base"),
        _kind(located("token", "token_end"), 3).alias("tokens"))
    # In order of their starts, a token is free if no span before it ends behind its start and
    # the next span starts behind its end.
    t = t.select("row", "doc_id", "base", F.array_sort(F.concat("base", "tokens")).alias("all"))
    far = 2**31 - 1
    t = t.select("*", F.transform("all", lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0))).alias("ends"),
                 F.transform(F.reverse("all"), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(far))).alias("starts"))
    t = t.select("*", running("ends", 0, F.greatest).alias("upto"), running("starts", far, F.least).alias("back"))
    free = F.filter(F.arrays_zip("all", "upto", F.reverse("back").alias("after")), lambda z: (
        (z["all"]["kind"] == 3) & (z["upto"] <= z["all"]["start"]) & (z["after"] >= z["all"]["end"])))
    return t.select("row", "doc_id", "base", F.transform(free, lambda z: F.struct(
        z["all"]["start"].alias("start"), z["all"]["end"].alias("end"), z["all"]["value"].alias("value"))).alias("tokens"))


def train(spans: DataFrame) -> DataFrame:
    """(pair, llr): log-likelihood ratio of each character pair, random against
    ordinary, from first-order counts with ``SMOOTH`` added to each pair.
    At most |alphabet|^2 rows, whatever the input."""
    random_ = spans.select(F.explode("base").alias("b")).select(
        F.lit(1).alias("y"), F.when(F.col("b.kind") == 0, F.regexp_extract(F.col("b.value"), ASSIGN, 2))
        .otherwise(F.col("b.value")).alias("token"))
    ordinary = spans.select(F.explode("tokens").alias("b")).select(F.lit(0).alias("y"), F.col("b.value").alias("token")).filter(
        F.col("token").rlike("^[A-Za-z_-]+$"))
    counts = (random_.unionByName(ordinary).select("y", F.explode(_pairs(F.col("token"))).alias("pair"))
              .groupBy("pair").agg(F.sum("y").alias("r"), F.sum(1 - F.col("y")).alias("o")))
    # Every pair of the alphabet gets a row, seen or not.
    spark = spans.sparkSession
    chars = F.explode(F.split(F.lit(ALPHABET), ""))
    first = spark.range(1).select(chars.alias("a")).filter("a <> ''")
    every = first.select("a", F.explode(F.split(F.lit(ALPHABET), "")).alias("b")).filter("b <> ''").select(
        F.concat("a", "b").alias("pair"))
    grid = every.join(counts, "pair", "left").select(
        "pair", F.substring("pair", 1, 1).alias("a"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    rows = grid.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    k = len(ALPHABET) * SMOOTH
    return grid.join(rows, "a").select("pair", (
        F.log((F.col("r") + SMOOTH) / (F.col("ra") + k)) - F.log((F.col("o") + SMOOTH) / (F.col("oa") + k))).alias("llr"))


def scan(docs: DataFrame, min_llr: float = MIN_LLR) -> DataFrame:
    """(doc_id, spans) with spans an array of (start, kind, end, value) in
    order of start, then kind; kind indexes ``KINDS``.

    Null texts count as empty and have no spans; every row is reported once, also
    rows that repeat. A corpus without samples of a class gives the models
    only their added counts, so that no token gains and only the patterns find.
    """
    spans = saved(base_spans(docs), "secret-spans")
    model = saved(train(spans), "secret-model")
    # A token's text stays behind while its pairs are counted.
    scored = (spans.select("row", F.posexplode("tokens").alias("i", "t"))
              .select("row", "i", F.explode(_pairs(F.col("t.value"))).alias("pair"))
              .join(F.broadcast(model), "pair", "left")  # |ALPHABET|^2 rows, fixed
              .groupBy("row", "i").agg(F.avg(F.coalesce("llr", F.lit(0.0))).alias("llr")))
    added = scored.filter(F.col("llr") >= min_llr).groupBy("row").agg(F.collect_list("i").alias("added"))
    joined = spans.join(added, "row", "left")
    more = F.transform(F.coalesce("added", F.expr("CAST(array() AS array<int>)")), lambda i: F.get("tokens", i))
    return joined.select("doc_id", F.array_sort(F.concat("base", _kind(more, 3))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
