"""Check SQL (DuckDB dialect) of the operators that SQL can say, written apart from their code."""

from __future__ import annotations

from probity.llm import pii, urls

SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(rule: str) -> str:
    body, head = (rule[2:], r"^(?:[^/?#]*\.)?") if rule.startswith("||") else (rule, "")
    parts = {"*": ".*", "^": "(?:[^a-zA-Z0-9_.%-]|$)"}
    return "(?is)" + head + "".join(parts.get(c, "\\" + c if c in ".+?$(){}[]|\\" else c) for c in body)


_HOSTS = ", ".join(f"({_quoted(r)}, {_quoted(v)}, {_quoted(r.split('/', 1)[0])}, {_quoted('/' + r.split('/', 1)[1])})" for r, v in urls.HOST_RULES.items())
_RULES = ", ".join(f"({_quoted(r)}, {_quoted(v)}, {_quoted(_pattern(r))})" for r, v in urls.PATTERN_RULES.items())

URL_FILTERS = f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS behind FROM pages),
parts AS (SELECT page_id, {SMALL.format("regexp_extract(behind, '^[^/?#]*')")} AS host, substr(behind, length(regexp_extract(behind, '^[^/?#]*')) + 1) AS rest FROM cut),
p AS (SELECT row_number() OVER () AS r, *, regexp_extract(rest, '^[^?#]*') AS path FROM parts),
hosts(rule, verdict, h, start) AS (VALUES {_HOSTS}),
rules(rule, verdict, regex) AS (VALUES {_RULES}),
host_fit AS (SELECT r, rule, verdict FROM p JOIN hosts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, rule DESC) = 1),
pattern_fit AS (SELECT r, rule, rules.verdict FROM p JOIN rules ON regexp_matches(host || rest, regex)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY rules.verdict, length(rule) DESC, rule DESC) = 1)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, q.verdict, 'allow') AS verdict, CASE WHEN f.rule IS NULL THEN q.rule END AS pattern
FROM p LEFT JOIN host_fit f USING (r) LEFT JOIN pattern_fit q USING (r)"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_WORDS.format(SMALL.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS.format(SMALL.format("coalesce(text, '')"))} AS w FROM benchmark) WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS pattern FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS pattern FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM b))),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN patterns USING (n, pattern)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({SMALL.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, root) AS (SELECT u, u FROM ways UNION SELECT v, root FROM reach JOIN ways ON u = reach.doc_id),
least_root AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_root r ON r.doc_id = d.doc_id"""

# Plain forms of the patterns; the character classes of the checks are those of the operator's contract.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT)
  ELSE (CAST(reverse({_DIGITS})[i] AS INT) * 2) // 10 + (CAST(reverse({_DIGITS})[i] AS INT) * 2) % 10 END)) % 10 = 0"""
_BARE = "replace(m, ' ', '')"
_MOD = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''), lambda c: CAST(CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INT))),
  lambda a, x: CAST((CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END) % 97 AS INT)) = 1"""
_CHECKS = {
    "email": "true", "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) <= 255))",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"CASE WHEN length({_BARE}) BETWEEN 15 AND 34 THEN {_MOD} ELSE false END",
    "ssn": f"regexp_matches(right(gap, {pii.CONTEXT_CHARS}) || ' ' || left(behind, {pii.CONTEXT_CHARS}), {_quoted(pii.NEARBY['ssn'])})",
}


def _kind(k: int, kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, ms[i] AS m, gaps[i] AS gap, gaps[i + 1] AS behind,
  CAST(coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) + list_sum(list_transform(gaps[1 : i], lambda x: length(x))) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS ms, string_split_regex(text, {_quoted(pattern)}) AS gaps FROM documents
    WHERE text IS NOT NULL) WHERE len(ms) > 0)) WHERE {_CHECKS[kind]}"""


_ALL = " UNION ALL ".join(_kind(k, *x) for k, x in enumerate(_KINDS.items()))
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)
_ZERO = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)
PERSONAL_DATA = f"""WITH spans AS ({_ALL}),
told AS (SELECT doc_id, {_COUNTS}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < {len(pii.BASE)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS every FROM spans GROUP BY doc_id)
SELECT d.doc_id, {_ZERO}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id"""

FILL_IN_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM k),
p AS (SELECT doc_id, t, n, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 : n], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

# The unsigned crc32 of the id's decimal text, bit by bit; then pairs of equal six-word windows at the same distance, in islands.
PERIODIC_RUNS = """WITH bytes AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda s: ascii(s)::BIGINT)),
    lambda c, s: xor(c >> 8, step[(xor(c, s) & 255) + 1])), 4294967295::BIGINT) AS h FROM documents CROSS JOIN bytes),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1 : a], list_transform(range(0, len(w) - a), lambda i: w[a + i % p + 1])) END AS w FROM p),
windows AS (SELECT r, i, array_to_string(w[i + 1 : i + 6], ' ') AS piece FROM (SELECT r, w, unnest(range(len(w) - 5)) AS i FROM t WHERE len(w) >= 12)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.r = y.r AND x.piece = y.piece AND x.i < y.i),
islands AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM t) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines.text, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256, CAST(len(w) AS BIGINT) AS n_words FROM t LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
