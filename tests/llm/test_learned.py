"""Secret scans, languages and toxicity: brute force for the fixed parts, held-out accuracy for the learned ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from probity.llm import language, secrets, toxicity
from probity.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
KINDS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18), "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id")


def brute_secrets(text):
    out = sorted((m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(m))
    told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in out)
    return tuple(sum(s[3] == k for s in out) for k in KINDS), hashlib.sha256(told.encode()).hexdigest(), told


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op5_secret_scan"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    extra = 0
    for doc, text in zip(docs.doc_id, docs.text):
        counts, sha, told = brute_secrets(text)
        r = got[doc]
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (counts, sha)
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
        extra += r.spans.count("model:")
    assert extra < 0.02 * len(docs)


def test_secret_edges(spark):
    rnd = random.Random(2)
    bits = ["token=", "Secret : '", "api_key=\"", "APIKEY:", "ſecret=abcdefghijklm", "AKIA", "ABCD1234EFGH5678", "deadbeef01234567", "AKIAAKIA" * 4, " ", "é", "\n", "token=secret=abc", "x9Y_zz12+/AB=", "passwd"]
    odd = [None, "", "é" * 30 + " token=abcdefghijkl.mn", "a1" * 50_000, "f" * 15 + " " + "f" * 16, "AKIA" + "A" * 13, "token=" + "Z" * 100_000]
    odd += ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
    rows = [(i if i != 1 else None, t, "s", [1]) for i, t in enumerate(odd)] + [(2, odd[2], "s", [1])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, found array<int>")
    got = secrets.scan(df).collect()
    want = sorted((r[0], *brute_secrets(r[1])[:2]) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, (r.n_assign, r.n_access, r.n_hex), r.base_sha256) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and secrets.scan(df.limit(0)).count() == 0


def test_threshold_keeps_recall_over_all_candidates(spark):
    # 20,000 candidates, one in 20 a labelled finding, with answers that overlap: the threshold's probability is far below a half.
    rng = np.random.default_rng(6)
    rows = []
    for i in range(2000):
        z = [float(v) for v in rng.normal(1.5 if i < 1000 else -1.0, 1.0, 1)] + [float(v) for v in rng.normal(-1.0, 1.0, 9)]
        rows.append((i, [], [(10 * k, 10 * k + 5, int(i < 1000 and k == 0), v) for k, v in enumerate(z)]))
    scored = spark.createDataFrame(rows, secrets.SCORED_SCHEMA)
    model = secrets.settled(scored)
    each = np.array([(c[2], c[3]) for r in rows for c in r[2]])
    good, other = each[each[:, 0] == 1, 1], each[each[:, 0] == 0, 1]
    assert 0.95 <= (good >= model.threshold).mean() < 0.97
    assert model.probability(model.threshold) < 0.3
    p = np.array([model.probability(z) for z in each[:, 1]])
    assert abs(p.mean() - each[:, 0].mean()) < 0.005  # the real share, not that of a balanced sample
    sent = spark.sparkContext.broadcast(model)
    got = scored.mapInArrow(lambda b: secrets._judged(b, sent), secrets.OUT_SCHEMA).collect()
    assert sum(len(r.findings) for r in got) == (other >= model.threshold).sum()


def test_network_learns_and_gradients():
    rnd = random.Random(1)
    word = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    good = ["login key=" + word("0123456789abcdefXYZ", 24) + " end" for _ in range(200)]
    bad = ["the PLAIN=" + word("AEIOUNSTR", 24) + " end" for _ in range(200)]
    texts = [secrets.windows(t, 10, 34)[0] for t in good + bad]
    y = np.repeat([1.0, 0.0], 200)
    net = secrets.Network().fit(texts, y)
    assert ((net.logits(texts) > 0) == (y > 0)).mean() > 0.98
    x, yy = secrets.symbols(texts[195:205]), y[195:205]
    fresh = secrets.Network(3)
    g = fresh.gradients(x, yy)
    loss = lambda: np.mean(np.logaddexp(0, fresh.forward(x)[0]) - yy * fresh.forward(x)[0])
    for name in ("conv", "out", "bias", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        fresh.p[name][at] += 1e-5
        up = loss()
        fresh.p[name][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[name][at]) < 1e-4
        fresh.p[name][at] += 1e-5


def test_long_candidates_are_read_whole():
    text = "x" + "A1" * 500
    parts = secrets.windows(text, 1, len(text))
    assert "".join(w[secrets.AROUND : secrets.AROUND + secrets.PIECE].rstrip("\0") for w in parts) == text[1:]


def test_language(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    right = []
    for doc, text, lang in zip(docs.doc_id, docs.text, docs.lang):
        r = got[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out:
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.98


def test_language_bundle_is_the_sum_of_bound_letters():
    text = "Ab  b, ñ"
    seq = [ord(c) for c in " ab b ñ "]
    want = np.zeros(language.DIMENSIONS)
    for i in range(len(seq) - 2):
        v = [language.letter_vectors(np.array([p], np.uint32))[0] for p in seq[i : i + 3]]
        want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    got = next(language.bundles([text, None]))
    assert (got[0] == want).all() and not got[1].any()
    a, b = (language.letter_vectors(np.array([p], np.uint32))[0].astype(int) for p in (97, 98))
    assert abs(a @ b) < 6 * language.DIMENSIONS**0.5


def brute_bundle(text):
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = np.zeros(language.DIMENSIONS)
    if not kept.strip():
        return out
    seq = [ord(c) for c in " " + " ".join(kept.split(" ")) + " "]
    seq = [c for i, c in enumerate(seq) if c != 32 or i == 0 or seq[i - 1] != 32]
    for i in range(len(seq) - 2):
        a, b, c = (language.letter_vectors(np.array([p], np.uint32))[0].astype(int) for p in seq[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_language_against_brute_force(spark):
    said = {"en": "the cat sat on the mat and then it slept", "de": "die katze saß auf der matte und schlief dann", "fr": "le chat était assis sur le tapis, puis il dormit"}
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = rng.choice(list(said))
        words = said[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), lang))
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 + 3", "fr"), (103, "x", None), (104, "Straße  -- 7 ÉTÉ", None), (105, "die", "de"), (105, "die", "de"), (None, "mat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, _, _ in rows}
    total = {g: sum((brute_bundle(t) for i, t, l in rows if l == g and not held[i]), np.zeros(language.DIMENSIONS)) for g in sorted(said)}
    got = language.identify(df, language.prototypes(language.learned_rows(df))).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        own = brute_bundle(texts[r.doc_id])
        assert r.held_out == held[r.doc_id]
        if not own.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {g: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for g, v in total.items()}
        best = max(cosine, key=lambda g: (round(cosine[g], 6), [-ord(c) for c in g]))
        weight = {g: np.exp(language.SHARPNESS * (c - cosine[best])) for g, c in cosine.items()}
        assert r.lang_pred == best and abs(r.score - weight[best] / sum(weight.values())) < 1e-4


def test_language_edges(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 !?", "en", 1.0), (None, "hello there", None, 1.0), (5, "hello there you", "en", 1.0), (5, "hello there you", "en", 1.0), (6, "ß " * 200_000, "de", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.prototypes(df)
    assert model[0] == ["de", "en"]
    got = sorted(map(tuple, language.identify(df, model).collect()), key=str)
    assert len(got) == 7 and [g[2] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and {g[2] for g in got if g[0] in (5, None)} == {"en"}
    none = language.prototypes(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_toxicity(spark, docs, labels):
    big = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, big).toPandas().set_index("doc_id")
    mark = spark.read.parquet(f"{big}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in got.held_out.items())
    held = got.join(mark).query("held_out and toxic == toxic")
    toxic, ordinary = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and ordinary.predicted.mean() < 0.03


def test_toxicity_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) toxic", "quality")
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, x)).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-9 for d in a)


def brute_shared(words):
    """Interpolated Kneser-Ney over the words' n-grams, by definition."""
    n = toxicity.ORDER
    whole = {}
    for w, c in words.items():
        s = f" {w} "
        for e in range(2, len(s) + 1):
            g = s[max(0, e - n) : e]
            whole[g] = whole.get(g, 0) + c
    grams = {n: {g: c for g, c in whole.items() if len(g) == n}}
    for k in range(n - 1, 0, -1):
        grams[k] = {g: c for g, c in whole.items() if len(g) == k}
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    d, one = toxicity.DISCOUNT, grams[1]

    def p(g):
        if len(g) == 1:
            return (one[g] + d) / (sum(one.values()) + d * len(one))
        own = [c for x, c in grams[len(g)].items() if x[:-1] == g[:-1]]
        return (max(grams[len(g)][g] - d, 0) + d * len(own) * p(g[1:])) / sum(own)

    return whole, p


def test_shared_model_by_definition(spark):
    words = {"loser": 3, "lo": 5, "los": 2, "ser": 1, "é": 1, "ababababab": 2}
    df = spark.createDataFrame([(w, c, 1) for w, c in words.items()], "word string, ordinary long, toxic long")
    whole, p = brute_shared({w: c + 1 for w, c in words.items()})
    got = {r.gram: r.p for r in toxicity.shared_model(toxicity._whole_grams(df)).collect()}
    assert got.keys() == whole.keys() and all(abs(got[g] - p(g)) < 1e-12 for g in got)


def test_joined_sums_equal_sent_sums(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = docs.selectExpr("doc_id", "false held_out", "text").union(spark.createDataFrame([(None, False, None), (-1, False, "")], "doc_id long, held_out boolean, text string"))
    a, b = ({r.doc_id: r for r in toxicity._totals(rows, model.entries, s).collect()} for s in (model.sent, None))
    assert a.keys() == b.keys()
    assert all(a[d].n_words == b[d].n_words and np.isclose(a[d].total, b[d].total) and np.isclose(a[d].excess, b[d].excess) for d in a)


def test_toxicity_edges(spark):
    rows = [(i, f"word{'abc'[i % 3]} plain text idiot" if i % 4 == 0 else "plain text only here", "x", 0.5) for i in range(60)] + [(100, None, "x", 0.5), (101, "", "x", 0.5), (None, "1 2", "x", 0.5), (0, rows0 := "dup", "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, total string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(60)] + [(61, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score(df, toxicity.train(df, labels.limit(0))).collect()
    assert len(none) == len(rows) and not any(r.predicted for r in none)
    assert toxicity.score(df.limit(0), toxicity.train(df, labels)).count() == 0


def test_toxicity_counts_every_learnable_fold(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % toxicity.PARTS
    ids = range(400)
    text = lambda i: "plain words of a text " + ("idiot" if i % 4 == 0 else "") + (" zqxvarn" if i % 4 == 0 and fold(i) == toxicity.CALIBRATION else "")
    docs = spark.createDataFrame([(i, text(i)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "g zqxva" in model.sent.value and toxicity.WordScores(model.sent.value)["zqxvarn"] > 0
    asked = spark.createDataFrame([(1, "plain words zqxvarn"), (2, "plain words text")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert score[1] > score[2]


def test_word_scores_by_place():
    """A place takes its n-gram's value with that of its context, or its context's alone, or nothing."""
    entries = {"c ": 0.5, "g a": 1.0, "c a": -0.25, "gab": 9.0, "c abcd": 2.0, "cabcde": 0.125, "gabcdef": 4.0}
    scores = toxicity.WordScores(toxicity.places_of(entries))
    for word in ["a", "ab", "abcdef", "b", "zzz"]:
        assert scores[word] == pytest.approx(sum(entries.get(k, 0.0) for k in toxicity._keys(word)))
