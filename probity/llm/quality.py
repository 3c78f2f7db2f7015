"""Quality rules: word, symbol and repetition statistics, fixed limits, and robust multivariate outliers.

For each language and source the minimum-covariance-determinant estimate gives a centre and a shape of the transformed
statistics: concentration steps on the nearest half of the documents, from several starts, until the determinant stops
falling; the smallest determinant is kept. A document too far from its group by Mahalanobis distance is rejected. All of
it is column expressions and grouped sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import SPACES, ready, slim, stored

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
SYMBOLS = r"[#*$%&|<>]"

FEATURES = ("f0", "f1", "f2", "f3")
FLOORS = (0.03, 0.15, 0.15, 0.15)  # smallest spread of each transformed statistic
SUBSET = 0.5  # the estimator's full breakdown point
STARTS = ("spreads", "signs", "bent")
FALL = 1e-3  # least fall of a log determinant that is worth another step
BENT_SQUARE = 0.394  # mean of tanh(x)^2 of a standard normal x
CHI2_MEDIAN = 3.357  # of four degrees of freedom
CUT = 60.0
LEAST_ROWS = 200
SMALL_CELLS = 20_000
EDGE = " \t\n\x0b\f\r"


def _repeated(df: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """Words inside windows that occur twice or more in the text, the first occurrence included.

    Windows are told apart by 64-bit hashes. Only a text with a repeated hash sorts its windows with their places.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    df = df.withColumn("_w", hashes)
    places = F.sequence(F.lit(0), F.size("_w") - window)
    grams = F.transform(places, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(window)]))
    df = df.withColumn("_g", F.when(F.size("_w") >= window, grams).otherwise(F.array().cast("array<long>")))
    again = F.size("_g") > F.size(F.array_distinct("_g"))
    df = df.withColumn("_p", F.when(again, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twin = lambda p, k: F.coalesce(F.get("_p", k - 1)["g"] == p["g"], F.lit(False)) | F.coalesce(F.get("_p", k + 1)["g"] == p["g"], F.lit(False))
    df = df.withColumn("_s", F.sort_array(F.transform(F.filter("_p", twin), lambda p: p["i"])))
    spans = F.transform("_s", lambda s, k: F.least(F.lit(window), F.coalesce(F.get("_s", k + 1) - s, F.lit(window))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop("_w", "_g", "_p", "_s")


def statistics(docs: DataFrame, id_column="doc_id", text_column="text", lang_column="lang", source_column="source", keep=()) -> DataFrame:
    """Statistics of every whole text beside its id, language, source and the columns to ``keep`` (as ``keep0``, ...)."""
    rows = slim(
        docs, doc_id=id_column, lang=docs[lang_column].cast("string"), source=docs[source_column].cast("string"), text=F.coalesce(docs[text_column], F.lit("")),
        **{f"keep{i}": c for i, c in enumerate(keep)},
    )
    rows = rows.withColumn("_trim", F.btrim("text", F.lit(EDGE)))
    rows = rows.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", f"[{SPACES}]+", -1)))
    rows = _repeated(rows, "_words", "n_repeat_words")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(EDGE)) != "")
    rows = rows.withColumn("_lines", lines)
    return rows.select(
        "doc_id", "lang", "source", *[f"keep{i}" for i in range(len(keep))],
        F.size("_words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(f"[{SPACES}]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """The statistics as logarithms of smoothed rates, so that a short text cannot stray far by chance."""
    n = F.col("n_words")
    return {
        "f0": F.log((F.col("word_chars") + 250) / (n + 50)),
        "f1": F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 200)),
        "f2": F.log1p(20 * F.col("n_dup_lines") / (n + 50)),
        "f3": F.log1p(5 * F.col("n_repeat_words") / (n + 50)),
    }


def _cell(level: int) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return [F.lit("all"), F.concat(F.lit("l"), part("lang")), F.concat(F.lit("s"), part("lang"), F.lit("\x01"), part("source"))][level]


def _inverse(params: DataFrame) -> DataFrame:
    """Adds ``i_jk``, the inverse of the Cholesky factor of the covariance ``c_jk``, floors added to its diagonal, and its log determinant ``volume``."""
    d = len(FEATURES)
    for i in range(d):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))) if i == j else value / F.col(f"l{j}{j}"))
    for j in range(d):
        for i in range(j, d):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l{i}{k}") * F.col(f"i{k}{j}")
            params = params.withColumn(f"i{i}{j}", value / F.col(f"l{i}{i}"))
    own = [f"i{i}{j}" for i in range(d) for j in range(i + 1)]
    volume = sum((2 * F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0))
    keys = [c for c in ("cell", "start") if c in params.columns]
    return params.select(*keys, "rows", *[f"m{i}" for i in range(d)], *own, volume.alias("volume"))


def _distance() -> Column:
    z = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    ys = [sum((F.col(f"i{i}{j}") * z[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(z))]
    return sum((y * y for y in ys), F.lit(0.0))


def _with(rows: DataFrame, params: DataFrame, keys=("cell",)) -> DataFrame:
    """Rows with the numbers of their cell. Few cells are sent to the rows; many are joined with skew handling."""
    return rows.join(F.broadcast(params) if params.count() <= SMALL_CELLS else params, list(keys))


def _moments(rows: DataFrame, inside: Column) -> DataFrame:
    d = range(len(FEATURES))
    x = [F.when(inside, F.col(f)) for f in FEATURES]
    return rows.groupBy("cell", "start").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(x[i]).alias(f"m{i}") for i in d],
        *[F.coalesce(F.covar_pop(x[i], x[j]), F.lit(0.0)).alias(f"c{i}{j}") for i in d for j in range(i + 1)],
    )


def _starts(rows: DataFrame) -> DataFrame:
    """First centre and shape of every cell with enough rows, by start.

    All begin at the medians. The shape has the median deviations alone, or with the directions from the centre, or with
    the deviations bent by tanh.
    """
    d = range(len(FEATURES))
    middle = [F.percentile_approx(f, 0.5, 10_000) for f in FEATURES]
    start = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *[m.alias(f"m{i}") for i, m in enumerate(middle)])
    start = _with(rows, stored(start.filter(F.col("rows") >= LEAST_ROWS)).drop("rows"))
    spread = start.groupBy("cell").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in d],
        *[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 10_000), F.lit(FLOORS[i])).alias(f"s{i}") for i, f in enumerate(FEATURES)],
    )
    far = _with(rows, stored(spread)).withColumns({f"z{i}": (F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}") for i, f in enumerate(FEATURES)})
    far = far.withColumn("far", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in d), F.lit(0.0))), F.lit(1e-12)))
    sign = [F.col(f"z{i}") / F.col("far") for i in d]
    bent = [F.tanh(f"z{i}") for i in d]
    pairs = [(i, j) for i in d for j in range(i + 1)]
    moments = far.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), *[F.first(f"{c}{i}").alias(f"{c}{i}") for c in "ms" for i in d],
        *[(F.avg(sign[i] * sign[j]) * len(FEATURES)).alias(f"g{i}{j}") for i, j in pairs],
        *[(F.avg(bent[i] * bent[j]) / BENT_SQUARE).alias(f"t{i}{j}") for i, j in pairs],
    )
    one = {"spreads": lambda i, j: F.lit(1.0 if i == j else 0.0), "signs": lambda i, j: F.col(f"g{i}{j}"), "bent": lambda i, j: F.col(f"t{i}{j}")}
    shapes = [F.struct(F.lit(k).alias("start"), *[(one[k](i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in pairs]) for k in STARTS]
    return moments.select("cell", "rows", *[f"m{i}" for i in d], F.inline(F.array(*shapes)))


def concentrated(rows: DataFrame) -> DataFrame:
    """The estimate of the smallest determinant of every cell, whichever start and step it came from."""
    keys, seen = ("cell", "start"), []
    params = stored(_inverse(_starts(rows)).withColumn("volume", F.lit(float("inf"))))
    while not params.isEmpty():
        far = _with(rows, params.drop("rows", "volume")).select(*keys, *FEATURES, _distance().alias("d2"))
        cuts = stored(far.groupBy(*keys).agg(F.percentile_approx("d2", SUBSET, 10_000).alias("cut")))
        step = stored(_inverse(_moments(_with(far, cuts, keys), F.col("d2") <= F.col("cut"))))
        seen.append(step)
        before = params.select(*keys, F.col("volume").alias("_before"))
        # A start that no longer falls is done; the determinants have a lower bound, so all of them end.
        params = stored(step.join(before, list(keys)).filter(F.col("_before") - F.col("volume") > FALL).drop("_before"))
    if not seen:
        return params
    rest = [c for c in seen[0].columns if c not in ("cell", "volume")]
    best = reduce(DataFrame.union, seen).groupBy("cell").agg(F.min(F.struct("volume", *rest)).alias("b"))
    return stored(best.select("cell", "b.*"))


def cell_shapes(stats: DataFrame) -> DataFrame:
    """Centre, inverse factor and scale of every (language, source), language, and of all documents, from ``LEAST_ROWS`` rows on."""
    levels = F.explode(F.array(*[_cell(i) for i in range(3)])).alias("cell")
    rows = stats.select("*", levels).select("cell", *FEATURES)
    params = concentrated(rows).drop("volume", "start")
    far = _with(rows, params.drop("rows")).select("cell", _distance().alias("d2"))
    scale = far.groupBy("cell").agg(F.percentile_approx("d2", 0.5, 10_000).alias("median"))
    # The centre of a group is narrower than the group: distances are scaled so that their median is the expected one.
    return stored(params.join(scale, "cell").withColumn("scale", F.greatest(F.col("median") / CHI2_MEDIAN, F.lit(1.0))).drop("median"))


def judge(docs: DataFrame, id_column="doc_id", text_column="text", lang_column="lang", source_column="source", keep=(), cut: float = CUT) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` (null where no group is large enough) and ``kept`` of every document.

    A document is judged within its language and source, or its language, or all documents: the narrowest with
    ``LEAST_ROWS`` rows; with fewer documents in all, by the fixed limits alone. Null languages and sources are groups of their
    own. Null and empty texts have no words and fail. Repeated rows are judged each; an empty table gives an empty result.
    Columns to ``keep`` come back as ``keep0``, ``keep1``, ...
    """
    ready(docs.sparkSession)
    stats = stored(statistics(docs, id_column, text_column, lang_column, source_column, keep).withColumns(transformed()))
    # Texts that fail the fixed limits say nothing about their group.
    shapes = cell_shapes(stats.filter(~base_failed()))
    known = shapes.select("cell").withColumn("_yes", F.lit(True))
    few = shapes.count() <= SMALL_CELLS
    rows = stats
    for level in (2, 1):
        own = known.filter(F.col("cell").startswith("?ls"[level])).select(F.col("cell").alias(f"_c{level}"), F.col("_yes").alias(f"_y{level}"))
        rows = rows.join(F.broadcast(own) if few else own, _cell(level) == F.col(f"_c{level}"), "left")
    cell = F.when(F.col("_y2"), _cell(2)).when(F.col("_y1"), _cell(1)).otherwise(_cell(0))
    rows = rows.withColumn("cell", cell).drop("_c1", "_y1", "_c2", "_y2")
    shapes = shapes.drop("rows")
    rows = rows.join(F.broadcast(shapes) if few else shapes, "cell", "left")
    out = rows.withColumns({"distance": _distance() / F.col("scale"), "base_failed": base_failed()})
    return out.select(
        "doc_id", *[f"keep{i}" for i in range(len(keep))], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & ~(F.coalesce(F.col("distance"), F.lit(0.0)) > cut)).alias("kept"),
    )
