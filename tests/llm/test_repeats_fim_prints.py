"""Periodic runs, fill-in-the-middle and fingerprints against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probity.llm import fim, fingerprint, runs
from probity.llm.queries import QUERIES

SHAPE = "doc_id long, text string, h string, part string, guard string, n string, runs string, output string, code string"
LONG = "one two three four five " * 60_000
ROWS = [
    (1, None, *"abcdefg"), (2, "", *"abcdefg"), (None, "null id a b c a b c a b c a b c", *"abcdefg"), (4, " \n\t ", *"abcdefg"),
    (5, "x " * 40, *"abcdefg"), (5, "x " * 40, *"abcdefg"), (5, "other text of id five", *"abcdefg"), (7, "has <P> inside", *"abcdefg"),
    (8, "日本語 tëxt one\x1ctwo\x85", *"abcdefg"), (90, LONG, *"abcdefg"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE)


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def brute_runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("aab"), max_size=40), st.integers(1, 9), st.integers(1, 6), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(head, period, times, least):
    words = head + (head[:period] or ["c"]) * times + head[::-1]
    assert runs.runs_in(words, least) == runs.runs_of(words, least) == brute_runs(words, least)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_rich_words(least):
    a, b = "b", "a"
    for _ in range(11):
        a, b = b, b + a  # Fibonacci words hold about as many runs as letters
    assert runs.runs_in(list(b), least) == brute_runs(list(b), least)
    binary = np.random.default_rng(5).integers(0, 2, 700).tolist()
    assert runs.runs_in(binary, least) == brute_runs(binary, least)


def test_squares_are_primitive_and_complete():
    words = np.random.default_rng(2).integers(0, 2, 120).tolist()
    want = set()
    for end in range(len(words)):
        for d in range(1, (end + 1) // 2 + 1):
            u = words[end - d + 1 : end + 1]
            if u == words[end - 2 * d + 1 : end - d + 1] and not any(d % k == 0 and u == u[:k] * (d // k) for k in range(1, d)):
                want.add((end, d))
    got = list(runs.squares(words))
    assert len(got) == len(set(got)) and set(got) == want


def planted(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, folder, texts):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(texts) and any(r.n_runs for r in got.values())
    for doc, text in texts.items():
        words, r = planted(doc, text), got[doc]
        found = brute_runs(words, 12)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])


def test_runs_edge_rows(spark, docs):
    rows = runs.find(docs).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert sum(r.doc_id == 5 and r.n_words == 40 for r in rows) == 2
    assert [tuple(x) for x in by[5, 40].runs] == [(0, 40, 1)] and by[5, 40].collapsed == b"x"
    assert by[1, 0].runs == by[2, 0].runs == by[4, 0].runs == [] and by[1, 0].collapsed == b""
    assert [tuple(x) for x in by[None, 14].runs] == [(2, 12, 3)]
    assert [tuple(x) for x in by[90, 300_000].runs] == [(0, 300_000, 5)] and by[90, 300_000].collapsed == b"one two three four five"
    assert by[8, 2].collapsed == ROWS[8][1].encode()
    assert runs.digest(runs.find(runs.with_periods(docs))).count() == len(ROWS)
    assert runs.find(docs.limit(0)).count() == runs.with_periods(docs.limit(0)).count() == 0


def brute_fim(doc, text, seed=1):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"{seed}:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_rows(spark, docs, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    seen = Counter()
    for df in (docs, table):
        want = [(r.doc_id, *brute_fim(r.doc_id, r.text), r.text or "") for r in df.collect()]
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode(), r.restored.decode()) for r in fim.restore(fim.transform(df)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        seen.update(r[2] for r in got)
    assert set(seen) == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Zé日\n<", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_fim_rotations(text, a, b, form):
    raw = text.encode()
    a, b = sorted((min(a, len(raw)), min(b, len(raw))))
    out = bytes(fim.rearrange(raw, a, b, form))
    p, m, s = raw[:a], raw[a:b], raw[b:]
    assert out == (b"<P>%b<S>%b<M>%b" % (p, s, m) if form == "psm" else b"<S>%b<P>%b<M>%b" % (s, p, m))
    assert fim.undo(out, form) == raw


def test_fim_cuts_over_many_blocks():
    text = ("ab é" * 60_000).encode()
    starts = fim.token_starts(np.frombuffer(text, np.uint8))
    per_block = np.add.reduceat(starts, np.arange(0, len(starts), fim.SCAN), dtype=np.int64)
    edges = [*np.flatnonzero(starts).tolist(), len(text)]
    assert all(fim.cut_at(starts, per_block, k) == edges[k] for k in range(0, len(edges), 997)) and fim.cut_at(starts, per_block, len(edges) - 1) == len(text)


def terms(text):
    words = ["", "", *text.encode().split()]
    return Counter(zip(words, words[1:], words[2:]))


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    many, rng = fingerprint.Sampler(samples=20_000), np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4)]
    for n, m in ((30, 10), (80, 80), (200, 20)):  # few words, so terms repeat and weights matter
        a = " ".join(rng.choice(vocabulary, n))
        b = a + " " + " ".join(rng.choice(vocabulary, m))
        x, y = (np.array([p[i : i + 4] for i in range(0, len(p), 4)]) for p in many.fingerprints(a, b))
        assert abs((x == y).mean() - jaccard(a, b)) < 0.015


def test_fingerprint_query(spark, folder, texts):
    got = {r.doc_id: r for r in QUERIES["op13_fingerprints"](spark, folder).collect()}
    order, off = sorted(texts), []
    sampler = fingerprint.Sampler()
    assert len(got) == len(order)
    for doc, after in zip(order, order[1:] + order[:1]):
        text, r = texts[doc] or "", got[doc]
        k = len(text) // 4
        edited = text[: len(text) - k] + (texts[after] or "")[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert [r.fingerprint] == sampler.fingerprints(text) and [r.edited_fingerprint] == sampler.fingerprints(edited)
        agree = [r.fingerprint[i : i + 4] == got[after].fingerprint[i : i + 4] for i in range(0, 256, 4)]
        assert r.near_next == sum(agree) / 64
        off.append(r.near_edited - jaccard(text, edited))
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.3


def test_fingerprint_edge_rows(spark, docs):
    rows = fingerprint.beside_next(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    after = {r.doc_id: r.next_id for r in rows}
    assert after[None] == 1 and after[1] == 2 and after[2] == 4 and after[4] == 5 and after[8] == 90 and after[90] is None
    assert sorted(r.next_id for r in rows if r.doc_id == 5) == [5, 5, 7]
    signed = {r.doc_id: r.fingerprint for r in fingerprint.sign(docs).collect()}
    assert signed[1] == signed[2] == signed[4] == "0" * 256 and all(r.fingerprint == signed[r.doc_id] for r in rows if r.doc_id != 5)
    assert fingerprint.beside_next(docs.limit(0)).count() == fingerprint.sign(docs.limit(0)).count() == 0
    one = fingerprint.beside_next(docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].next_id == 8 and one[0].fingerprint == one[0].next_fingerprint


def test_neighbours_with_a_hot_id(spark):
    ids = [None] * 400 + [3] * 400 + list(range(10, 600))
    df = spark.createDataFrame([(d, f"text {i} of {d}", i % 7) for i, d in enumerate(ids)], "doc_id long, text string, code int")
    rows = fingerprint.beside_next(df).collect()
    assert len(rows) == len(ids)
    chain = Counter((r.doc_id, r.next_id) for r in rows)
    assert chain[None, None] == chain[3, 3] == 399 and chain[None, 3] == chain[3, 10] == chain[599, None] == 1
    assert all(chain[i, i + 1] == 1 for i in range(10, 599))


def test_fingerprints_of_texts_with_the_same_start():
    """Words of the shared start are looked up once, whichever character it ends at, and give the same fingerprints."""
    looked_up = []

    class Counted(fingerprint.Codes):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    text, following = "un mot, dé jà  vu\u00a0là et le même mot encore une fois", " autre début tout à fait"
    plain, counted = fingerprint.Sampler(), fingerprint.Sampler()
    counted.codes = Counted()
    for k in range(len(text) + 1):
        edited = text[:k] + following
        assert counted.fingerprints(text, edited, same=k) == plain.fingerprints(text) + plain.fingerprints(edited)
    looked_up.clear()
    counted.fingerprints(text, text + following, same=len(text))
    assert len(looked_up) == len(text.encode().split()) + 1 + len(following.split())


def test_merged_runs():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (300, 1, 200)]
    assert fingerprint.merged(runs).tolist() == sorted(set(np.concatenate(runs).tolist()))
