"""URL filters: pattern rules indexed by their rarest literal token.

Rules are written in a small form: ``||`` anchors a host and its subdomains, ``*`` stands for any characters, ``^`` for a
separator or the end, anything else for itself. A token of a rule that stands between separators must be a token of every
matching URL, so a rule is kept under the one that is rarest among the URLs. The tokens of a URL fetch their rules, and
only those run as regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import ready, slim, stored

SMALL_RULES = 50_000

# Host and path rules that decide first, the longest winning.
HOST_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Own default patterns for the URLs that no host rule fits.
PATTERN_RULES = {
    "/ads/": "block", "/banner^": "block", "^adserver^": "block", "||doubleclick.net^": "block", "||tracker.*^": "block", "^casino^": "block",
    "^porn^": "block", "^xxx^": "block", "^poker^": "block", "^torrent^": "block", "/wp-admin/": "block", "/wp-login.php": "block", "^login^": "block",
    "^signup^": "block", "^cart^": "block", "^checkout^": "block", "^phpsessid^": "block", "^sessionid^": "block", "?replytocom=": "block",
    ".exe^": "block", ".zip^": "block", ".apk^": "block", "/privacy-policy^": "block", "/feed/": "block", "/cgi-bin/": "block",
    "^affiliate^*^ref^": "block", "^news^*^casino^": "allow", "||login.*^docs^": "allow",
}


def rule_table(spark: SparkSession, host_rules: dict[str, str] = HOST_RULES, pattern_rules: dict[str, str] = PATTERN_RULES) -> DataFrame:
    """Rules as rows ``rule, verdict, is_host``. A host rule is its text behind a host anchor."""
    rows = [(r, v, True) for r, v in host_rules.items()] + [(r, v, False) for r, v in pattern_rules.items()]
    return spark.createDataFrame(rows, "rule string, verdict string, is_host boolean")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z small; else empty."""
    host = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def rest_of(url: Column) -> Column:
    """What follows the host: path, query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*(.*)$", 1), F.lit(""))


def _compiled(rules: DataFrame) -> DataFrame:
    """Adds the regular expression and the literal tokens of each rule."""
    text = F.when(F.col("is_host"), F.concat(F.lit("||"), F.col("rule"))).otherwise(F.col("rule"))
    anchored = text.startswith("||")
    body = F.when(anchored, F.substring(text, F.lit(3), F.length(text))).otherwise(text)
    plain = F.regexp_replace(body, r"([\\.+?$(){}\[\]|])", r"\\$1")
    plain = F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^a-z0-9_.%-]|$)"))
    # Host rules keep the case of the path; the others ignore it.
    head = F.when(anchored, F.lit(r"(?s)^(?:[^/?#]*\.)?")).otherwise(F.lit("(?s)"))
    regex = F.concat(F.when(F.col("is_host"), F.lit("")).otherwise(F.lit("(?i)")), head, plain)
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]++(?=[^a-z0-9*])"), F.lit(0))
    return rules.withColumns({"regex": regex, "tokens": F.array_distinct(tokens)})


def url_tokens(address: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(address), "[^a-z0-9]+", -1), lambda t: t != ""))


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def rule_index(addresses: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """Rules under ``token``, the one of theirs that the fewest URLs have; a rule without a sure token under the empty one."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = addresses.select(F.explode(url_tokens(F.col("address"))).alias("token"))
    counts = seen.join(_sent(wanted, small), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("*", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    return each.groupBy("rule", "verdict", "is_host", "regex").agg(F.coalesce(rarest, F.lit("")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame | None = None, id_column="page_id", url_column="url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` of every page.

    The longest fitting host rule decides (ties by text); else any fitting allow pattern, else any block pattern
    (the longest is named in ``pattern``), else allow. A null URL, or one without ``://``, has empty host and path and is
    allowed; null and repeated ids and repeated URLs are rows of their own; no rules allow all; an empty table gives an empty result.
    Up to ``SMALL_RULES`` rules are sent to the tasks; more are joined on their tokens.
    """
    spark = ready(pages.sparkSession)
    rules = _compiled(rule_table(spark) if rules is None else rules)
    small = rules.count() <= SMALL_RULES
    rows = slim(pages, page_id=id_column, url=url_column)
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), rest_of(F.col("url")).alias("rest"))
    rows = rows.withColumn("address", F.concat("host", "rest"))
    index = stored(rule_index(rows, rules, small))
    found = rows.withColumns({"_row": F.monotonically_increasing_id(), "path": F.regexp_extract("rest", r"^[^?#]*", 0)})
    tokens = F.array_union(url_tokens(F.col("address")), F.array(F.lit("")))
    each = found.select("_row", "page_id", "host", "path", "address", F.explode(tokens).alias("token"))
    each = each.join(_sent(index, small), "token", "left")
    # A host rule looks at host and path alone.
    fits = F.when(F.col("is_host"), F.rlike(F.concat("host", "path"), F.col("regex"))).otherwise(F.rlike("address", F.col("regex")))
    rank = F.struct(F.length("rule"), "rule", "verdict")
    host_rule, allow, block = (F.max(F.when(fits & c, rank)) for c in (F.col("is_host"), ~F.col("is_host") & (F.col("verdict") == "allow"), ~F.col("is_host") & (F.col("verdict") == "block")))
    best = each.groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), host_rule.alias("h"), allow.alias("a"), block.alias("b")
    )
    pattern = F.when(F.col("h").isNull(), F.coalesce(F.col("a.rule"), F.col("b.rule")))
    verdict = F.coalesce(F.col("h.verdict"), F.col("a.verdict"), F.col("b.verdict"), F.lit("allow"))
    return best.select("page_id", "host", "path", F.col("h.rule").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"))
