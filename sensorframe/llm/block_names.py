"""Exact duplicate removal by deterministic block naming.

Every normalised text is cut into blocks of a fixed number of characters.
The distinct blocks are sorted and numbered, so that equal blocks have equal
integer names and different blocks have different ones. Adjacent names are then
paired, the distinct pairs sorted and numbered again, until one name is left
of every document. That name and the number of blocks identify the text
without collisions: no hash value ever decides that two texts are equal.
Hashes only decide which task sorts a block.

A name is given in two steps, so that a block held by a third of the rows is
sorted by many tasks: rows are dealt by (hash bucket, salt) and ranked there;
one representative per rank goes to the bucket, where it gets its final
number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, keep_rows, numbered, row_texts, saved

#: Characters in a block.
BLOCK = 1024
#: Buckets over which distinct blocks are sorted, and salts over which the copies of one block are dealt.
BUCKETS = 1 << 16
SALTS = 64


def normalised(text):
    """The text without its white space (the characters of ``[\\x20\\x09-\\x0D]``)."""
    return F.translate(text, SPACES, "")


def name_rows(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """Adds ``name`` to ``rows`` (row, i, ..., *key) and drops the key columns:
    equal keys share one integer name, different keys never do."""
    other = [c for c in rows.columns if c not in key]
    dealt = rows.select(
        *other, *key,
        F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64("row", "i"), F.lit(SALTS)).cast("int").alias("salt"))
    order = W.partitionBy("bucket", "salt").orderBy(*key)
    ranked = dealt.withColumn("rank", F.dense_rank().over(order)).withColumn("before", F.lag("rank").over(order))
    is_head = F.col("before").isNull() | (F.col("before") != F.col("rank"))
    # One copy of each key per (bucket, salt) stays beside its rank; the others carry only the rank.
    ranked = saved(ranked.select(*other, "bucket", "salt", "rank", is_head.alias("head"),
                                 *[F.when(is_head, F.col(k)).alias(k) for k in key]), label)
    heads = ranked.filter("head").select(
        "bucket", "salt", "rank",
        (F.col("bucket").cast("long") * (1 << 40)
         + F.dense_rank().over(W.partitionBy("bucket").orderBy(*key))).alias("name"))
    return ranked.select(*other, "bucket", "salt", "rank").join(heads, ["bucket", "salt", "rank"]).select(*other, "name")


def text_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, n_chars, text_sha256, blocks, name), one row per row of
    ``docs``; (blocks, name) is equal for two rows exactly when their
    normalised texts are equal.

    Empty and null texts are one block of no characters."""
    texts = row_texts(docs).select(
        "row", "doc_id", F.length("text").alias("n_chars"),
        normalised(F.col("text")).alias("t"))
    n = F.greatest(F.ceil(F.length("t") / block), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("t", i * block + 1, F.lit(block)))
    texts = texts.select("row", F.struct("doc_id", "n_chars", F.sha2(F.col("t").cast("binary"), 256).alias(
        "text_sha256"), n.alias("blocks")).alias("info"), cut.alias("cut"))
    # A text's facts travel with its first block only.
    # Outer, though no cut is empty: else Spark checks its size below the projection and normalises the text again for every block.
    rows = (texts.select("row", "info", F.posexplode_outer("cut").alias("i", "block"))
            .select("row", "i", F.when(F.col("i") == 0, F.col("info")).alias("info"), "block"))
    names = saved(name_rows(rows, ["block"], "blocks"), "block-names")
    out = names.filter("info.blocks = 1").select("row", "info", "name")
    longest = names.agg(F.max("info.blocks")).first()[0] or 1
    rest = names.join(names.filter("info.blocks > 1").select("row"), "row", "left_semi") if longest > 1 else None
    while longest > 1:
        pairs = (rest.groupBy("row", F.shiftright("i", 1).alias("i"))
                 .agg(F.max("info").alias("info"),
                      F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
        rest = saved(name_rows(pairs, ["left", "right"], "pairs"), "pair-names")
        longest = (longest + 1) // 2
    if rest is not None:
        out = out.unionByName(rest.select("row", "info", "name"))
    return out.select("row", "info.*", "name")


def _grouped(docs: DataFrame, block: int) -> DataFrame:
    """``exact_duplicates`` with the row."""
    rows = text_names(docs, block)
    # Saved, so that the join below is a plain one whose large groups Spark can split.
    groups = saved(rows.groupBy("blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id"), F.col("row"))).alias("best")), "block-groups")
    return rows.join(groups, ["blocks", "name"]).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal normalised texts the row with the most code points in its original
    text stays, then the smallest doc_id (null first). Null texts count
    as empty; empty texts equal each other and texts of white space only. When
    the row that stays is repeated as a whole, its repeats count in group_size
    and are reported with kept = false, except one. No rows give no rows;
    columns other than doc_id and text are not looked at.
    """
    return _grouped(docs, block).drop("row")


def drop_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all columns:
    one of each group, also where rows repeat a doc_id or have none."""
    rows = numbered(docs)
    return keep_rows(rows, _grouped(rows, block).filter("kept"))
