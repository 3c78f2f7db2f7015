"""Stages of the pipeline, each against brute force on its own input."""

import zlib

import numpy as np

import corpus_pipeline
from test_native import brute_quality
from test_neardup import brute, shingles
from test_tokens_mix_bench import brute_hits, library_ids

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}

    def step(name, docs):
        out = stages[name](spark, docs, FOLDER)
        assert name == "tokens" or out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = step("quality", docs)
    before, after = rows_of(docs), rows_of(good)
    assert set(after) <= set(before)
    gone = [r for r in before if r not in set(after)]
    assert all(r in set(after) or brute_quality(r[1])[5] or labels.get(r[0]) != 1 for r in before)
    assert gone and not any(brute_quality(r[1])[5] for r in after)

    single = step("near_duplicates", good)
    want = [d for d, _, _, first in brute([(r[0], r[1]) for r in after], 5, 80) if first]
    assert rows_of(single) == sorted([r for r in after if r[0] in set(want)], key=str) and len(want) < len(after)

    clean = step("decontaminate", single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {h[0] for h in brute_hits([(r[0], r[1]) for r in rows_of(single)], items) if h[5]}
    assert rows_of(clean) == [r for r in rows_of(single) if r[0] not in bad] and bad

    mix = step("mix", clean)
    from probity.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert rows_of(mix) == sorted([r for r in rows_of(clean) for _ in range(copies[r[0]])], key=str)

    tokens = sorted(step("tokens", mix).collect(), key=lambda r: r.start)
    texts = sorted((r[0], r[1]) for r in rows_of(mix))
    assert [r.doc_id for r in tokens] == [d for d, _ in texts]
    start = 0
    for r, (_, text) in list(zip(tokens, texts)):
        assert r.start == start
        start += r.n_tokens
    for r, (_, text) in list(zip(tokens, texts))[::7]:
        ids = library_ids(text)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_edges(spark):
    rows = [(1, None, None, None, None), (None, "words " + " ".join(map(str, range(40))), None, "s", 1), (2, "", "en", "s", 0)]
    rows += [(3, " ".join(f"a{i}" for i in range(50)), "en", "t", 5), (4, " ".join(f"a{i}" for i in range(50)), "en", "t", 5), (3, " ".join(f"a{i}" for i in range(50)), "en", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, FOLDER)
            now = spark.createDataFrame(now.collect(), now.schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if shingles(r.text, 5)) == [(False, 3), (True, None)]


def test_run_and_entry(spark, folder):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries()
    got = entry.queries()["pipeline"](spark, folder)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns) and got.count() > 0
