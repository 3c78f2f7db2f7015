"""URL filters, quality rules and personal data against plain Python; no Python runs in their plans."""

import hashlib
import random
import re

import pytest

from probity.llm import pii, quality, urls
from probity.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, folder):
    return {t: spark.read.parquet(f"{folder}/{t}.parquet").toPandas() for t in ("documents", "pages", "labels")}


@pytest.mark.parametrize("name", ["op2_url_filters", "op7_quality_rules", "op9_personal_data"])
def test_plans_are_native(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def split_url(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, rest[len(host) :]


def brute_url(url, patterns):
    host, path, rest = split_url(url)
    fits = []
    for rule, verdict in urls.HOST_RULES.items():
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    kinds = set()
    for rule, verdict in patterns.items():
        body = rule.removeprefix("||")
        r = "".join({"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%\-]|$)"}.get(c, re.escape(c)) for c in body)
        if re.search((r"^(?:[^/]*\.)?" if rule != body else "") + r, host + rest, re.I | re.S):
            kinds.add(verdict)
    return host, path, None, "allow" if "allow" in kinds or not kinds else "block"


def test_urls(spark, folder, tables):
    got = QUERIES["op2_url_filters"](spark, folder)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted((p, *brute_url(u, urls.PATTERN_RULES)) for p, u in zip(tables["pages"].page_id, tables["pages"].url))
    assert sorted(tuple(r)[:5] for r in got.collect()) == want


def test_url_edges(spark):
    odd = [
        None, "", "no scheme/net/", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?x", "http://A.Example.NET/en/1#f", "x://example.net/EN/",
        "http://example.net/en", "http://notexample.com/de/", "http://sub.example.com/de/?q=://net/", "http://x.org/fr/ads/", "http://x.org/ads/b", "http://adserver.io",
        "http://x.io/banner?1", "http://x.io/banners", "https://a.tracker.co.uk:80/", "http://x.io/p?affiliate=1&ref=2", "http://x.io/news/9/casino", "http://x.io/casino",
        "http://x.io/CASINO/", "http://x.io/y.exe", "http://x.io/y.exec", "http://x.io/a\nb/ads/", "http://login.x.io/docs", "http://x.io/?replytocom=4", "://net/", "a://b://net/",
        "http://x.io/" + "long-" * 3000 + "casino",
    ]
    rows = [(i if i else None, u, "clash", "clash") for i, u in enumerate(odd)] + [(7, odd[7], "a", "b")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    got = urls.judge(pages).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(((r[0], *brute_url(r[1], urls.PATTERN_RULES)) for r in rows), key=str)
    assert urls.judge(pages.limit(0)).count() == 0
    none = urls.rule_table(spark, {}, {"*": "allow"}).limit(0)
    assert {r.verdict for r in urls.judge(pages, none).collect()} == {"allow"}


def test_rules_under_rarest_token(spark):
    pages = spark.createDataFrame([("a.common/rare/",), ("a.common/x",), ("a.common/y/rare2",)], "address string")
    rules = urls._compiled(urls.rule_table(spark, {"a.common/": "block"}, {"/common/rare/": "block", "^*ads": "block"}))
    index = {r.rule: r.token for r in urls.rule_index(pages, rules, True).collect()}
    assert index == {"a.common/": "a", "/common/rare/": "rare", "^*ads": ""}


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    w = SPACE.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {}
    for g in grams:
        many[g] = many.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, folder, tables):
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op7_quality_rules"](spark, folder).collect()}
    d = tables["documents"]
    assert len(got) == len(d)
    for doc, text in zip(d.doc_id, d.text):
        assert got[doc][:6] == brute_quality(text)
        assert not (got[doc][5] and got[doc][6])


def test_quality_edges_and_outliers(spark):
    rnd = random.Random(5)
    clean = [" ".join(rnd.choice(["alpha", "beta", "of", "gamma", "the", "delta"]) + str(rnd.randrange(99)) for _ in range(rnd.randrange(15, 400))) for _ in range(600)]
    odd = [None, "", " \n", "a b c d e a b c d e", "\x0bx\x0c y\r\n z", "line one\nline one\n\nline one \n", "ä ö ü ß " * 9, "w " * 50_000, "x" * 100_000, "# " * 30]
    bad = [" ".join("##$$%%" + str(i * 7 + k) for i in range(80)) for k in range(5)]
    rows = [(i, t, "en" if i % 2 else None, "s", 5, 1.5) for i, t in enumerate([*clean, *odd, *bad, odd[4], odd[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, distance double")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute_quality(r[1]), r[1] and r[1][:50]
    assert all(got[i].kept for i in range(600))
    assert not any(got[600 + len(odd) + k].kept for k in range(5))
    few = {r.doc_id: r for r in quality.judge(docs.limit(50)).collect()}
    assert all(r.distance is None and r.kept != r.base_failed for r in few.values())
    assert quality.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.4])
def test_outliers_up_to_nearly_half_of_a_cell(spark, share):
    rnd = random.Random(8)
    rows = []
    for i in range(1000):
        bad = i < 1000 * share
        marks = lambda: rnd.choice(["##", "$%", "*|"]) if bad else ""
        text = " ".join(rnd.choice(["alpha", "beta", "of", "gamma", "the", "delta"])[:3] + marks() + str(rnd.randrange(9999)) for _ in range(rnd.randrange(200, 400)))
        rows.append((i, text, "en", "hot"))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in got if got[i].kept] == [i for i in got if i >= 1000 * share]


def test_smallest_determinant_of_all_starts_and_steps(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 4)) @ np.array([[1, 0.9, 0, 0], [0, 0.3, 0.5, 0], [0, 0, 1, 0.8], [0, 0, 0, 0.3]])
    a[:150] += [2, -3, 2, -3]
    rows = spark.createDataFrame([("x", *map(float, p)) for p in a], "cell string, f0 double, f1 double, f2 double, f3 double")
    got = quality.concentrated(rows).first()
    floors, best = np.diag(np.square(quality.FLOORS)), np.inf
    m = np.median(a, axis=0)
    s = np.maximum(1.4826 * np.median(abs(a - m), axis=0), quality.FLOORS)
    z = (a - m) / s
    sign, bent = z / np.linalg.norm(z, axis=1)[:, None], np.tanh(z)
    for shape in (np.eye(4), 4 * sign.T @ sign / 400, bent.T @ bent / 400 / quality.BENT_SQUARE):
        centre, c = m, shape * np.outer(s, s)
        for _ in range(50):
            y = a - centre
            d = ((y @ np.linalg.inv(c + floors)) * y).sum(axis=1)
            near = a[np.argsort(d)[:200]]
            centre, c = near.mean(axis=0), np.cov(near.T, bias=True)
            best = min(best, np.linalg.slogdet(c + floors)[1])
    assert best - 0.05 <= got.volume <= best + 0.05


def test_covariance_factor(spark):
    import numpy as np

    a = np.random.default_rng(1).normal(size=(50, 4)) @ np.array([[1, 0.2, 0, 0], [0, 1, 0.5, 0], [0, 0, 1, 0.1], [0, 0, 0, 1]])
    c = np.cov(a.T, bias=True)
    row = {"cell": "x", "rows": 50, **{f"m{i}": float(a[:, i].mean()) for i in range(4)}, **{f"c{i}{j}": float(c[i, j]) for i in range(4) for j in range(i + 1)}}
    shape = quality._inverse(spark.createDataFrame([row]))
    points = spark.createDataFrame([(*map(float, p), "x") for p in a], "f0 double, f1 double, f2 double, f3 double, cell string")
    got = [r.d for r in points.join(shape, "cell").select(quality._distance().alias("d"), "f0").orderBy("f0").collect()]
    inverse = np.linalg.inv(c + np.diag(np.square(quality.FLOORS)))
    want = [float((p - a.mean(0)) @ inverse @ (p - a.mean(0))) for p in a[a[:, 0].argsort()]]
    assert np.allclose(got, want)


# The plain patterns of the base kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn_ok(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end(), kind))
    out = sorted(out)
    told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in out)
    return tuple(sum(s[3] == k for s in out) for k in PLAIN), hashlib.sha256(told.encode()).hexdigest(), told


def test_personal_data(spark, folder, tables):
    got = {r.doc_id: r for r in QUERIES["op9_personal_data"](spark, folder).collect()}
    for doc, text in zip(tables["documents"].doc_id, tables["documents"].text):
        counts, sha, told = brute_pii(text)
        r = got[doc]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, sha)
        assert set(told.split(",")) <= set(r.spans.split(","))


def test_personal_data_edges(spark):
    rnd = random.Random(9)
    alphabet = ["a", "@", ".", "b-c", "_", "1", "+1", " ", "4", "0", "(", ")", "-", "255", "256", "ü", "é@", "\n", "4111 1111 1111 1111", "1.2.3.4", "+49 170 1234567", "x@y.zz"]
    odd = [
        None, "", "ñ a@b.c.d@e.f", "a@b.com_x@d.e", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "00001.2.3.4", "999.1.1.1", "+1 (269) 555-3296 4524132264652876", "+1 ((((", "4111-1111-1111-1111",
        "4111  1111", "a" * 60_000 + "@", "1" * 50_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "7 " * 3000 + "x 1.2.3.4 " * 700, "+" * 5000 + "1 2 3 4 5 6 7 8 9",
    ]
    odd += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    rows = [(i, t, "x", [1]) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, base array<int>")
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    for i, text, *_ in rows:
        counts, sha, _ = brute_pii(text)
        r = got[i]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, sha), text and text[:80]
    assert pii.digest(pii.find(docs.limit(0))).count() == 0


def test_running_sums_of_long_arrays(spark):
    sizes = [0, 1, 2, 255, 256, 257, 511, 512, 513, 5000]
    df = spark.createDataFrame([([(i * 7) % 11 for i in range(n)],) for n in sizes], "x array<long>")
    for r in df.select("x", pii._sums_before("x").alias("s")).collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


def test_text_with_very_many_matches(spark):
    text = "".join(f"é{i} mail u{i}@ex.org;" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.digest(pii.find(docs)).first()
    counts, sha, _ = brute_pii(text)
    assert (r.n_email, r.base_sha256) == (20_000, sha) and counts[0] == 20_000


def test_added_kinds(spark):
    texts = ["my IBAN DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "GB82WEST12345698765432,", "ssn: 123-45-6789", "part 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    kinds = [[s.kind for s in got[i].spans] for i in range(5)]
    assert kinds == [["iban"], [], ["iban"], ["ssn"], []]
    s = got[0].spans[0]
    assert texts[0][s.start : s.end] == s.value == "DE89 3704 0044 0532 0130 00" and s.score == 1.0


def test_anchored_rule_stays_on_the_host(spark):
    """A rule for a domain does not fit a query or fragment that names it."""
    rules = spark.createDataFrame([("||ads.co^", "block", False)], "rule string, verdict string, is_host boolean")
    rows = ["http://x.ads.co/", "http://a.com?u=x.ads.co", "http://a.com#x.ads.co", "http://ads.co?q", "http://a.com/x.ads.co/", "http://bads.co/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.pattern for r in urls.judge(pages, rules).collect()}
    assert got == {0: "||ads.co^", 1: None, 2: None, 3: "||ads.co^", 4: None, 5: None}
