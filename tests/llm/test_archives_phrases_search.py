"""WARC archives, collocations and ranked search against brute force, on small
tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import collocations, ranked, warc

PAGE = "page_id long, url string, html string, file string, start long"
DOC = "doc_id long, text string, lang string, item_id long, rank int, words int, phrase string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, None, None, 1, "x") for i, t, g in rows], DOC)


# --- WARC ------------------------------------------------------------------------------------

INNER = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
PAGES = [(1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200), (3, None, "x" * 999), (4, "u\r\nWARC-Type: bad", "x" * 999),
         (5, "", None), (6, "http://c", ""), (None, "http://n", "é" * 700), (7, "http://d", "é" * 700),
         (8, "http://e", "a\n" + INNER * 3 + "tail\r\n"), (9, "http://f", "WARC/1.1\r\nnot a header\r\n\r\n"), (10, "http://g", "\r\n" * 520),
         (11, "http://h", "WARC/1.1\r\nContent-Length: 10\r\n"), (12, "http://i", "\n".join("line %d" % i for i in range(150))),
         (13, "http://j", INNER * 9), (14, "http://k", INNER * 9), (15, "http://l", "y\r\n\r\n" * 210 + "\r"), (15, "http://l", "y\r\n\r\n" * 210 + "\r")]


def archive(spark, tmp_path, rows=PAGES):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([(*r, "f", 0) for r in rows], PAGE).repartition(3), path)
    return path


def sequential(path):
    """(file, offset, fields, payload) by reading each file from its start, one record after another."""
    for f in sorted(Path(path).glob("part-*")):
        data, at = f.read_bytes(), 0
        while at < len(data):
            head, n, fields = warc.parse_head(data[at:])
            assert data[at + head + n:at + head + n + 4] == b"\r\n\r\n"
            yield f.name, at, fields, warc.payload_of(fields, data[at + head:at + head + n])
            at += head + n + 4


@pytest.mark.parametrize("split", [400, 1 << 27])
def test_archives_are_read_as_from_their_start(spark, tmp_path, split, monkeypatch):
    path = archive(spark, tmp_path)
    whole = warc.pieces_of

    def small_blocks(*args, **kw):  # only the archives are read in small blocks
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        try:
            return whole(*args, **kw).coalesce(4).checkpoint()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    monkeypatch.setattr(warc, "pieces_of", small_blocks)
    got = warc.read_archives(spark, path, payloads=True).collect()
    bare = warc.read_archives(spark, path).collect()
    expect = list(sequential(path))
    assert len(expect) == len(PAGES)
    key = lambda r: (r.file.rsplit("/", 1)[1], r.offset)
    assert sorted((*key(r), bytes(r.payload), sorted(r.fields.items())) for r in got) == sorted(
        (f, o, p, sorted(d.items())) for f, o, d, p in expect)
    facts = sorted((f, o, len(p), hashlib.sha1(p).hexdigest()) for f, o, _, p in expect)
    for rows in (got, bare):
        assert sorted((*key(r), r.payload_bytes, r.payload_sha1) for r in rows) == facts


def test_revisits_name_the_largest_page(spark, tmp_path):
    rows = warc.resolve_revisits(warc.read_archives(spark, archive(spark, tmp_path))).collect()
    got = sorted((r.fields.get("x-page-id") or "", r.type, r.fields.get("warc-refers-to"), r.payload_bytes, r.payload_sha1) for r in rows)
    expect = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        best = max((j or -1) for j, _, h in PAGES if (h or "") == (html or ""))
        again = len(data) >= 1000 and (i or -1) != best
        expect.append((str(i) if i else "", "revisit" if again else "response", f"<urn:page:{best}>" if again else None,
                       len(data), hashlib.sha1(data).hexdigest()))
    assert got == sorted(expect)


def test_damaged_and_empty_archives(spark, tmp_path):
    folder = tmp_path / "own"
    folder.mkdir()
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nX: a\r\n b\r\nContent-Length: 7\r\n\r\n1\r\n\r\n3\n\r\n\r\n"
    (folder / "good").write_bytes(record * 2)
    (folder / "cut").write_bytes(record + record[:-9])
    (folder / "noise").write_bytes(b"noise\n" + record)
    (folder / "gap").write_bytes(record + b"junk\r\n" + record)
    (folder / "none").write_bytes(b"")
    got = warc.read_archives(spark, str(folder), payloads=True).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, bytes(r.payload), r.fields["x"]) for r in got) == [
        ("cut", 0, b"1\r\n\r\n3\n", "a b"), ("gap", 0, b"1\r\n\r\n3\n", "a b"), ("good", 0, b"1\r\n\r\n3\n", "a b"),
        ("good", len(record), b"1\r\n\r\n3\n", "a b")]
    path = str(tmp_path / "of_none")
    warc.write_archives(spark.createDataFrame([], PAGE), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


# --- collocations ----------------------------------------------------------------------------

def brute_phrases(rows, least, top, longest=5):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for p in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", p) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= cand[p[i:i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in dropped:
                s, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, total[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(rng, n):
    out = []
    for i in range(n):
        w = [rng.choice(["the", "The", "a", "of", "tea", "pot", "é", "ÉT", "x\x00", "日本"]) for _ in range(rng.randrange(40))]
        out.append((i, "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\x0b", "!"]) for x in w), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least,top,sizes", [(5, 2000, {"buckets": 4, "block": 300, "held": 40}), (30, 12, {"buckets": 64}), (5, 50, {})])
def test_collocations(spark, least, top, sizes):
    rng = random.Random(least)
    rows = texts(rng, 120) + [(500, None, "en"), (501, "", "en"), (502, "a b " * 3000, "en"), (503, "tea pot. " * 700, "fr"), (504, " \n.", "xx")]
    rows += [rows[3]] * 6
    got = collocations.collocations(docs_of(spark, rows).repartition(5), top=top, least=least, **sizes).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, least, top)
    assert collocations.collocations(docs_of(spark, [])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = [("en", 0, "", 3 * 10**15), ("en", 1, "p", 10**12 + 7), ("en", 1, "q", 10**12 + 9), ("en", 2, "p q", 10**12 + 3)]
    table = spark.createDataFrame(big, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(collocations, "frequencies", lambda *a, **k: table)
    (r,) = collocations.collocations(docs_of(spark, [])).collect()
    assert r.score == 1000 * (10**12 + 3) * 3 * 10**15 // ((10**12 + 7) * (10**12 + 9)) and r.k == 1


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for least in (2, 7, 40):
        keys = np.concatenate([rng.zipf(1.3, 4000) % 3000, np.arange(2000)]).astype(np.uint64)
        rng.shuffle(keys)
        capacity, kept, counts, taken = len(keys) // least + 1, np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for part in np.array_split(keys, 60):
            part, n = np.unique(part, return_counts=True)
            kept, counts, cut = collocations.pruned(*collocations.merged([(kept, counts), (part, n)]), capacity)
            taken += cut
            assert len(kept) <= capacity
        true = Counter(keys.tolist())
        have = dict(zip(kept.tolist(), counts.tolist(), strict=True))
        assert taken < least
        for key, n in true.items():
            assert have.get(key, 0) <= n <= have.get(key, 0) + taken
            assert n < least or key in have


# --- ranked search ---------------------------------------------------------------------------

def brute_search(docs, items, top):
    terms = lambda t: [x.decode() for x in ranked.terms_of((t or "").encode())]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    bags = [(i, Counter(pattern.findall(low(t)))) for i, t, _ in docs]
    assert all(Counter(terms(t)) == b for (_, t, _), (_, b) in zip(docs, bags, strict=True))
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            if not b:
                continue
            m = 75 + (25 * sum(b.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m))
                    for t, k in Counter(terms(text)).items() if t in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(-1 if item is None else item, n, x if known else None, -s) for n, (s, known, x) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,short,batch", [(60, 2, 10), (10**6, 1, 10**6), (300, 10**6, 30)])
def test_ranked_search(spark, segment, short, batch, monkeypatch):
    monkeypatch.setattr(ranked, "SPAN", 4)
    rng = random.Random(segment)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "Ab9", "日本", "x_y"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(rng.randrange(10**9), text(rng.randrange(40)), "en") for _ in range(200)]
    docs += [(None, text(20), "en"), (None, text(5), "en"), (7, None, "en"), (8, "", "en"), (9, ".;\n", "en"), (3, text(4000), "en")]
    docs += [docs[5]] * 3 + [(i, "t1 t2 same", "en") for i in range(30)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(50, None), (51, ""), (None, "t1 t3"), (52, "unknown"), (53, "same SAME t1"),
                                                                      (3, "ab9 É"), (3, "ab9 É")]
    index = ranked.build_index(docs_of(spark, docs).repartition(4), segment)
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)),
                        top=8, batch_terms=batch, short=short).collect()
    assert sorted([(-1 if r.item_id is None else r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str) == brute_search(docs, items, 8)


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(ranked.build_index(docs_of(spark, [])), some).count() == 0
    assert ranked.search(ranked.build_index(docs_of(spark, [(1, "a", "en")])), none).count() == 0
