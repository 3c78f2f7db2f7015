"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Only column functions are used. The places of matches come from the texts between them: a text split by the pattern gives
the gaps, and running sums of the lengths of gaps and matches give every start in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import ready, slim

# The kinds in order. Possessive forms and the look at the character before say the same as the plain
# patterns, in time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}  # a character without which there is no match
NEARBY = {
    "email": r"(?i)e-?mail|contact|write|address", "ip": r"(?i)\bip\b|address|host|server|login", "card": r"(?i)card|visa|credit|debit|payment",
    "phone": r"(?i)phone|call|mobile|tel\b|contact|fax", "iban": r"(?i)iban|bank|account|konto|compte|cuenta", "ssn": r"(?i)\bssn\b|social security|tax id|passport|identity",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT_CHARS = 60
CONTEXT_GAIN = 0.3
LEAST_SCORE = 0.6
PREFIX_BLOCK = 256

SPAN = "array<struct<start:long,kind_no:int,end:long,kind:string,value:string,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check over a string of digits."""
    back = F.reverse(number)
    digit = lambda i: F.ascii(F.substring(back, i, F.lit(1))) - 48
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    term = lambda i: F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """The check digits of an account number without spaces: moved to the end, letters as 10 to 35, the rest is 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda a, c: F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), lambda a, i: step(a, code(i))) == 1


def _valid(kind: str, x: Column) -> Column:
    """Whether a match stands; a length limit comes before each loop over its characters."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: F.when(F.length(part(p)) > 3, F.lit(False)).otherwise(F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(x)).between(12, 19), luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        plain = F.replace(x, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


def _sums_before(lengths: str) -> Column:
    """Running sums before each element: one pass over blocks appends their running sums, elements add up inside their block.

    The sums of the blocks are bound to a variable, so that they are made once and not once per element.
    """
    zero, add = F.lit(0).cast("long"), lambda a, x: a + x
    total = lambda a: F.aggregate(a, zero, add)
    within = lambda b: F.slice(lengths, b * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK))
    last = F.floor((F.size(lengths) - 1) / PREFIX_BLOCK).cast("int")
    run = lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + total(within(b))))
    begins = F.aggregate(F.sequence(F.lit(0), last), F.array(zero), run)
    place = lambda i: F.floor(i / PREFIX_BLOCK).cast("int")
    sums = lambda at: F.transform(
        lengths, lambda _, i: F.get(at, place(i)) + total(F.slice(lengths, place(i) * PREFIX_BLOCK + 1, i % PREFIX_BLOCK))
    )
    short = F.transform(lengths, lambda _, i: total(F.slice(lengths, F.lit(1), i)))
    return F.when(F.size(lengths) <= PREFIX_BLOCK, short).otherwise(F.get(F.transform(F.array(begins), sums), F.lit(0)))


def _kind_spans(rows: DataFrame, kind: str, number: int) -> DataFrame:
    """Adds ``_k<number>``: the confirmed spans of a kind, or null where there is no match."""
    pattern, need = PATTERNS[kind], NEEDS.get(kind)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = rows.withColumn("_m", F.when(F.contains("text", F.lit(need)), found) if need else found)
    rows = rows.withColumn("_gap", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    rows = rows.withColumn("_len", F.transform("_m", lambda m, i: (F.length(m) + F.length(F.get("_gap", i))).cast("long")))
    rows = rows.withColumn("_at", F.when(F.size("_gap") > 0, _sums_before("_len")))
    near = lambda i: F.concat_ws(" ", F.substring(F.get("_gap", i), -CONTEXT_CHARS, CONTEXT_CHARS), F.substring(F.get("_gap", i + 1), 1, CONTEXT_CHARS))
    score = lambda i: F.least(F.lit(1.0), PRIOR[kind] + F.when(F.rlike(near(i), F.lit(NEARBY[kind])), CONTEXT_GAIN).otherwise(0.0))

    def span(m: Column, i: Column) -> Column:
        start = F.get("_at", i) + F.length(F.get("_gap", i))
        return F.when(
            _valid(kind, m),
            F.struct(
                start.cast("long").alias("start"), F.lit(number).alias("kind_no"), (start + F.length(m)).cast("long").alias("end"), F.lit(kind).alias("kind"),
                m.alias("value"), score(i).alias("score"),
            ),
        )

    spans = F.filter(F.transform("_m", span), lambda s: s.isNotNull())
    return rows.withColumn(f"_k{number}", F.when(F.size("_gap") > 0, spans)).drop("_m", "_gap", "_len", "_at")


def find(docs: DataFrame, id_column="doc_id", text_column="text", keep=()) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every whole text: arrays of (start, kind_no, end, kind, value, score).

    ``base`` has the four pattern kinds that pass their checks; ``spans`` adds account numbers that pass mod-97 and
    identity numbers whose score, with the words nearby, is at least ``LEAST_SCORE``. Starts and ends count code points, the end
    exclusive. Null and empty texts have no spans; repeated rows and null ids are kept as they are; an empty table
    gives an empty result. Columns to ``keep`` come back as ``keep0``, ``keep1``, ...
    """
    ready(docs.sparkSession)
    rows = slim(docs, doc_id=id_column, text=F.coalesce(docs[text_column], F.lit("")), **{f"keep{i}": c for i, c in enumerate(keep)})
    for number, kind in enumerate(PATTERNS):
        rows = _kind_spans(rows, kind, number)
    none = F.array().cast(SPAN)
    parts = [F.coalesce(F.col(f"_k{i}"), none) for i in range(len(PATTERNS))]
    more = [F.filter(p, lambda s: s["score"] >= LEAST_SCORE) for p in parts[len(BASE) :]]
    return rows.select(
        "doc_id", *[f"keep{i}" for i in range(len(keep))], F.sort_array(F.concat(*parts[: len(BASE)])).alias("base"),
        F.sort_array(F.concat(*parts[: len(BASE)], *more)).alias("spans"),
    )


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
