"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators.indexing import global_index

from . import block_names, collocations, mixing, order_minhash, quality, quotes, ranked, repeats, secrets, tiling, token_counts, toxicity, warc
from .common import read_table, saved


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read_table(spark, sf_dir, "documents")
    labels = quality.training_side(read_table(spark, sf_dir, "labels"))
    model = quality.fit(docs, labels, ids=quality.training_side(docs.select("doc_id")))
    return quality.score(docs, model)


def quoted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in mail from ``conversations``: every turn is a message whose text
    quotes the turn before and, one level deeper, the turn before that. A
    message's id and time are its row number by (conv_id, turn), so that
    conversations of any length stay apart and a long one spreads over the time
    span; rows without conv_id or turn are left out."""
    c = read_table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = saved(global_index(c.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], "n"), "quote-turns")
    before = lambda k: turns.select("conv_id", (F.col("n") + k).alias("n"), F.col("text").alias(f"before{k}"))
    mark = lambda text, sign: F.when(text.isNull(), "").otherwise(
        F.concat(F.regexp_replace(text, "(?m)^", sign), F.lit("\n")))
    text = F.concat(mark(F.col("before2"), ">> "), mark(F.col("before1"), "> "), F.coalesce("text", F.lit("")))
    return turns.join(before(1), ["conv_id", "n"], "left").join(before(2), ["conv_id", "n"], "left").select(
        F.col("n").alias("msg_id"), F.col("n").alias("sent"), F.col("role").alias("author"), text.alias("text"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from quoting messages."""
    return quotes.conversations(quoted_messages(spark, sf_dir))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings that start earlier."""
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level BPE vocabulary."""
    import public_tokenizers
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return tiling.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document."""
    return block_names.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in every document."""
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    path = warc.archive_folder(spark)
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    records = warc.resolve_revisits(warc.read_archives(spark, path))
    refers = F.regexp_extract(F.col("fields")["warc-refers-to"], r"^<urn:page:(-?\d+)>$", 1)
    return records.select(
        F.col("fields")["x-page-id"].cast("long").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(refers != "", refers).cast("long").alias("refers_to"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents")).drop("k")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    index = ranked.build_index(read_table(spark, sf_dir, "documents"))
    return ranked.search(index, read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_quotation_linking, op3_repeated_substrings, op4_token_counts, op5_toxicity, op6_decontamination, op7_mixing,
    op8_exact_dedup, op9_secrets, op10_order_minhash, op11_warc, op12_collocations, op13_ranked_search)}
SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id
            FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
        FROM t""",
    "op12_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
        ws AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
        pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
        gram AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM pos, range(1, 6) r(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, words, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
        total AS (SELECT lang, count(*) AS n FROM pos GROUP BY lang),
        cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
        part AS (SELECT lang, a AS outer_a, array_to_string(w[i:i + k - 1], ' ') AS phrase
                 FROM cand, range(1, 6) r(i), range(2, 5) s(k) WHERE k < words AND i + k - 1 <= words),
        dropped AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN part p ON c.lang = p.lang AND c.phrase = p.phrase WHERE 100 * outer_a >= 100 * c.a),
        cut AS (
            SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n,
                   ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM (SELECT * FROM cand, range(1, 5) s(k) WHERE k < words) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.words], ' ')
            JOIN total ON total.lang = c.lang
            WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = c.lang AND d.phrase = c.phrase)),
        low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM low QUALIFY rank <= 2000""",
    "op13_ranked_search": r"""
        WITH tok AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        sized AS (SELECT *, len(terms)::BIGINT AS n FROM tok WHERE len(terms) > 0),
        stat AS (SELECT count(*)::BIGINT AS cn, sum(n)::BIGINT AS cl FROM sized),
        post AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
        df AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term),
        item AS (SELECT row_number() OVER () AS nr, item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        want AS (SELECT nr, item_id, term, count(*)::BIGINT AS k FROM item GROUP BY ALL),
        scored AS (
            SELECT nr, item_id, row, doc_id, sum(k * floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * cn) // cl))))::BIGINT AS score
            FROM want JOIN df USING (term) JOIN post USING (term), stat GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY nr ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
