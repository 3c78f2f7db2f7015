"""Near-duplicates against comparing all pairs."""

import random

import pytest

from probity.llm import graph, neardup
from probity.llm.queries import QUERIES


def shingles(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode("utf-8", "surrogatepass").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    post = {}
    for i, s in enumerate(sets):
        near = set()
        for x in s:
            near.update(post.get(x, ()))
            post.setdefault(x, []).append(i)
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[find(i)] = min(d, name.get(find(i), d))
    out = [(d, len(sets[i]), name.get(find(i)), name.get(find(i)) == d) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert rows_of(QUERIES["op6_near_duplicates"](spark, folder)) == want
    assert any(not w[3] for w in want)


@pytest.mark.parametrize("blocks", [(4096, 2048), (8, 5)])
def test_groups_chains_and_edges(spark, blocks):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):  # each group: edits of a text, and edits of edits
        base = [rnd.choice(vocabulary) for _ in range(90)]
        for _ in range(rnd.choice([2, 5, 40])):
            edit = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 6])):
                edit[rnd.randrange(len(edit))] = rnd.choice(vocabulary)
            texts.append(" ".join(edit))
            if rnd.random() < 0.2:
                base = edit
    shared = " ".join(vocabulary[:60])  # a passage that many texts share
    texts += [shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(30)) for _ in range(60)]
    texts += [None, "", "  \n", "one", "One", "two words", "two  WORDS", "Ä ä", "ä ä"]
    ids = list(range(1, len(texts) + 1))
    rnd.shuffle(ids)
    rows = [*zip(ids, texts), (None, texts[0]), (None, "lonely without id here"), (ids[3], texts[3]), (ids[3], "same id other text")]
    data = [(d, t, "x", 1, 2) for d, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, digest string, node int, cluster int")
    for words, percent in ((3, 85), (5, 80)):
        got = neardup.link(docs, words=words, percent=percent, list_block=blocks[0], set_block=blocks[1])
        assert rows_of(got) == brute(rows, words, percent)


def test_empty_table(spark):
    assert neardup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wanted_matches():
    assert neardup.wanted_matches(0.85) == 17 and neardup.wanted_matches(0.8) < 17


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    # Small files that hold many array elements look small enough to be sent; only the lengths of the long lists may be.
    plans = []

    def noted(df, stored=neardup.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(neardup, "stored", noted)
    monkeypatch.setattr(graph, "stored", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(20)], "doc_id long, text string")
    for found in (neardup.groups(docs), neardup.one_of_each(docs)):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 10
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) <= 2, joins  # one in each call
