"""The corpus pipeline, stage by stage, against brute force on a small fixture."""

import os
import random
import re

from sensorframe.llm import tiling
from sensorframe.session import list_dirs

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    clean = [text(rng.randrange(40, 90)) for _ in range(60)]
    items = [text(20) for _ in range(3)]
    rows, kind = [], {}

    def add(tokens, label, sep=" "):
        kind[len(rows)] = label
        t = None if tokens is None else sep.join(tokens)
        rows.append((len(rows), t, "en", "ab"[len(rows) % 2], len(t or "")))

    for c in clean:
        add(c, "clean")
    for c in clean[:10]:
        add(c, "copy", "  ")  # longer, so it is the one that stays
    for c in clean[20:30]:
        near = list(c)
        near[7] = "changed"
        add(near, "near")
    for i in items:
        add(text(10) + i[10:] + text(6) + i[:10] + text(9), "leak")  # reordered
    for k in range(40):
        add(["filthy", "scum", "vermin"] + text(20), "toxic")
    add(None, "empty")
    add([], "empty")
    rows.append(rows[0])
    kind[len(rows) - 1] = "copy"
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(kind[i] == "toxic")) for i in range(len(rows) - 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    root = spark.sparkContext.getCheckpointDir() + "/sensorframe-work"
    before = set(list_dirs(spark, root))

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append([tuple(r) for r in docs.collect()])
        assert (name == "mixing") == (docs.columns != ["doc_id", "text", "lang", "source", "n_chars"])
    # Only the last stage's work folders are left.
    assert len(set(list_dirs(spark, root)) - before) < 12

    ids = [sorted(r[0] for r in k) for k in kept]
    start = sorted(r[0] for r in rows)
    assert ids[0] == [i for i in start if kind[i] != "toxic"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in kept[0]:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    assert ids[1] == sorted(min(g)[1] for g in groups.values())
    # A near copy and its original: one of the two stays, and nothing else goes.
    pairs = {i: 20 + n for n, i in enumerate(i for i in range(len(rows) - 1) if kind[i] == "near")}
    assert all((a in ids[2]) != (b in ids[2]) for a, b in pairs.items())
    assert set(ids[1]) - set(ids[2]) <= set(pairs) | set(pairs.values())
    seeds = {}
    number = lambda ws: [seeds.setdefault(w, len(seeds) + 1) for w in ws]
    covered = lambda t, i: sum(n for n, _, _ in tiling.tile(number(i), number(tiling.words_of(t or "")))) >= tiling.COVERAGE * len(i)
    assert ids[3] == sorted(i for i, t, *_ in kept[2] if not any(covered(t, x) for x in items))
    assert all(kind[i] != "leak" for i in ids[3])
    assert ids[4] == ids[3]
    final = {r[0]: r for r in cp.run(spark, folder).collect()}
    assert sorted(final) == ids[4] and os.path.isdir(folder)
