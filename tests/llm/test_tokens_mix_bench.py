"""Token shards, mixing and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probity.llm import decontaminate, mixing, wavelet
from probity.llm.queries import QUERIES, TOKENIZER

DOCS = "doc_id long, text string, source string, part string, bucket string, items string"
ROWS = [
    (3, "The the end. " * 40, "b", "x", "y", "z"), (1, None, None, None, None, None), (2, "", "a", None, None, None), (None, "null id", "a", "p", "q", "r"),
    (1, "same id\n\n two  spaces ", "b", "p", "q", "r"), (5, "rep", "a", "p", "q", "r"), (5, "rep", "a", "p", "q", "r"), (9, "日本語 tëxt <|endoftext|> it's", "c", "", "", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def tables(spark, folder):
    return {t: spark.read.parquet(f"{folder}/{t}.parquet").toPandas() for t in ("documents", "benchmark")}


PLAIN = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def library_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n, width", [(1, 3), (511, 16), (512, 16), (513, 17), (4000, 5)])
def test_wavelet_matrix(n, width):
    ids = np.random.default_rng(n).integers(0, 1 << width, n)
    m = wavelet.WaveletMatrix.build(ids, width)
    assert (m.decode() == ids).all()
    for i in range(0, n, 97):
        assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        where = np.flatnonzero(ids == ids[i])
        assert m.count(int(ids[i])) == len(where) and [m.select(int(ids[i]), k) for k in range(len(where))] == where.tolist()


def test_encoder_equals_library(tables):
    e = wavelet.Encoder(public_tokenizers.path(TOKENIZER))
    odd = ["", " ", " a", "a ", "a  b", "a \n b", "x<|endoftext|> y", "x <|endoftext|> y", "t\t x", "it's  we're 'll", "\n", "é　ſK z", "a\x1cb \x85c"]
    texts = [*odd, *tables["documents"].text.fillna("")]
    for text, ids in zip(texts, e.batch(texts)):
        assert [*ids.tolist(), 2] == library_ids(text)


def test_shards_round_trip(spark, folder, tables):
    got = QUERIES["op1_wavelet_shards"](spark, folder).toPandas().set_index("doc_id")
    start = 0
    for doc, text in sorted(zip(tables["documents"].doc_id, tables["documents"].text)):
        ids = library_ids(text)
        assert tuple(got.loc[doc][["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(tables["documents"])


def test_shards_edge_rows(spark, docs):
    path = wavelet.write_shards(docs, public_tokenizers.path(TOKENIZER), shard_tokens=40)
    rows = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 5, 5, 9]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    want = sorted(zlib.crc32(np.array(library_ids(r[1]), "<u4").tobytes()) for r in ROWS)
    assert sorted(r.ids_crc32 for r in rows) == want
    empty = wavelet.write_shards(docs.limit(0), public_tokenizers.path(TOKENIZER))
    assert wavelet.read_documents(spark, empty).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in left)
        above = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not above:
            return {**out, **{s: weight[s] * level for s in left}}
        for s in above:
            out[s] = 2 * sizes[s]
            left.remove(s)
            rest -= 2 * sizes[s]


def test_mix(spark, folder, tables):
    q = QUERIES["op3_mix_sources"]
    got = q(spark, folder).toPandas().set_index("doc_id").sort_index()
    d = tables["documents"].set_index("doc_id").sort_index()
    size = d.text.fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (got["size"] == size).all() and len(got) == len(d)
    total = size.groupby(d.source.fillna("\0")).sum()
    want = brute_targets({s: int(n) for s, n in total.items()})
    for s, g in got.groupby(d.source.fillna("\0")):
        assert g.source_size.eq(total[s]).all() and np.allclose(g.target, want[s])
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() / 2 + 1
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    assert q(spark, folder).toPandas().set_index("doc_id").sort_index().equals(got)


def test_mix_tree_and_edges(spark, docs):
    many = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 7 as int)) text", "if(id % 3 = 0, 'hot', cast(id % 5 as string)) source")
    out = mixing.mix(many, leaf_rows=100, fan_in=3).toPandas()
    for _, g in out.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3.6
    assert len(out) == 3000
    edge = mixing.mix(docs).toPandas()
    assert len(edge) == len(ROWS) and (edge.taken <= 2 * edge["size"]).all() and edge["size"].min() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert (mixing.mix(docs.withColumn("text", docs.text.substr(0, 0))).toPandas().taken == 0).all()


def test_mixed_rows_that_share_id_and_text(spark):
    rows = [(7, "a b c", s, n) for s, n in (("x", 1), ("x", 2), ("y", None), (None, 1), (None, None))]
    rows += [(7, "a b c", "x", 1)] * 3 + [(None, "a b c", "x", 1), (8, None, "x", 1), (9, "", "y", 1)]
    rows += [(100 + i, "w " * (1 + i % 5), "xy"[i % 2], i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.key, r.row_key] += r.copies
    assert len(want) == len(set(rows))
    made = docs.withColumns({"k": F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), "rk": mixing.row_key(docs)}).distinct().collect()
    wanted = Counter({tuple(r)[:4]: want[r.k, r.rk] for r in made})
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == +wanted
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0
    mapped = spark.createDataFrame([(1, "a b", "s", {"k": 1}), (1, "a b", "s", {"k": 2})], "doc_id long, text string, source string, m map<string,int>")
    assert mixing.mix(mapped).select("row_key").distinct().count() == 2


def test_transfer_keeps_words_and_expectation():
    gone = 0.0
    for i in range(4000):
        a, b = [3, i, 0, 0.4], [7, i + 10**6, 0, 0.7]
        done, rest = mixing.meet(a, b)
        assert done[3] in (0.0, 1.0) and abs(3 * a[3] + 7 * b[3] - 6.1) < 1e-9
        gone += a[3]
    assert abs(gone / 4000 - 0.4) < 0.03


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = small(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = small(text), set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[p]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontaminate(spark, folder, tables):
    got = QUERIES["op4_decontaminate"](spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_hits(zip(tables["documents"].doc_id, tables["documents"].text), zip(tables["benchmark"].item_id, tables["benchmark"].text))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(w[2] for w in want)


def test_decontaminate_edges_and_blocks(spark, docs):
    long = " ".join(f"w{i % 23}" for i in range(3000))
    texts = [(0, "The End the!"), (1, None), (2, ""), (3, long), (4, "x " + long[:90] + " y Ä ä"), (None, "the end"), (4, "the end"), (4, "the end")]
    items = [(1, "the END"), (2, long[:200]), (2, long[:200]), (None, "Ä"), (10, None), (11, " "), (12, "w3 w4 w5"), (13, "the")]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    for size in (200_000, 10):
        found = decontaminate.find(d, b, block_words=size)
        assert sorted(map(tuple, decontaminate.judged(found).collect()), key=str) == want
    assert decontaminate.judged(decontaminate.find(d, b.limit(0))).filter("contaminated or n_items > 0").count() == 0
    assert decontaminate.judged(decontaminate.find(d.limit(0), b)).count() == 0
    assert decontaminate.judged(decontaminate.find(docs, b)).count() == len(ROWS)


def test_long_items_are_cut_and_blocks_come_one_at_a_time(spark, monkeypatch):
    words = [f"w{i}" for i in range(2000)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("é", "Ünder, score!"), ("mid", " ".join(words[500:530]))], "item_id string, text string")
    texts = [" ".join(words[i : i + 13]) for i in range(0, 1980, 9)] + [" ".join(words[100:112]), "an Ünder SCORE", " ".join(words), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    assert sum(bool(r[4]) for r in want) == len(texts) - 3
    order = []
    block, keep = decontaminate.block_items, decontaminate.stored
    monkeypatch.setattr(decontaminate, "block_items", lambda p, i: order.append(b := block(p, i)) or b)
    monkeypatch.setattr(decontaminate, "stored", lambda df: order.append("stored") or keep(df))
    assert sorted(map(tuple, decontaminate.find(docs, bench, block_words=400).collect())) == want
    # The pieces are stored, then blocks and searched rows take turns.
    assert len(order) > 10 and all((x == "stored") == (i % 2 == 0) for i, x in enumerate(order))
    assert max(sum(len(t.split()) for _, t in b) for b in order[1::2]) < 2 * 400


def test_mixed_sends_no_counts(spark):
    docs = spark.createDataFrame([(i, "one two three", "a") for i in range(20)], "doc_id long, text string, source string")
    found = mixing.mixed(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    at = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in at and "_row_key" in at, plan
