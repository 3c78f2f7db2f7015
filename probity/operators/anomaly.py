"""Feature anomaly scores, their summaries and the preparation of model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.operators.ordered import collapse, running_sums
from probity import constants as K

EPS = 1e-6

CATEGORIES = {
    "text_features": K.TEXT_FEATURES,
    "temporal_features": K.TEMPORAL_FEATURES,
    "user_behavior_features": K.USER_FEATURES,
    "content_features": K.CONTENT_FEATURES,
    "business_features": K.BUSINESS_FEATURES,
}
EXTENDED = {
    "text_features": K.TEXT_FEATURES,
    "temporal_features": K.TEMPORAL_FEATURES,
    "user_behavior_features": K.USER_FEATURES + K.USER_RISK_FEATURES,
    "content_features": K.CONTENT_FEATURES + K.CONTENT_RISK_FEATURES,
    "business_features": K.BUSINESS_FEATURES + K.BUSINESS_RISK_FEATURES,
}


def resolve(df: DataFrame, categories: dict[str, list[str]] = EXTENDED) -> dict[str, list[str]]:
    """Categories limited to the features the table has; settled when the plan is built."""
    have = set(df.columns)
    out = {k: [f for f in v if f in have] for k, v in categories.items()}
    return {k: v for k, v in out.items() if v}


def all_features(categories: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(f for v in categories.values() for f in v))


def moments(df: DataFrame, features: list[str]) -> Column:
    """Mean and sample deviation of every feature: one pass, used as a scalar sub-query."""
    parts = []
    for f in features:
        parts += [F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}")]
    return df.agg(F.struct(*parts).alias("m")).scalar()


def z_scores(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``<feature>_anomaly`` = |x - mean| / (deviation + 1e-6)."""
    out = df.withColumn("_m", moments(df, features))
    z = {
        f"{f}_anomaly": F.abs(F.col(f) - F.col(f"_m.m_{f}")) / (F.col(f"_m.s_{f}") + EPS)
        for f in features
    }
    return out.withColumns(z).drop("_m")


def _widest(columns: list[str]) -> Column:
    cols = [F.col(c) for c in columns]
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def category_scores(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Adds ``<category>_max``: the largest z of the category on the row."""
    return df.withColumns(
        {f"{c}_max": _widest([f"{f}_anomaly" for f in fs]) for c, fs in categories.items()}
    )


def category_summary(df: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Per category: mean of the row maximum, rows whose maximum exceeds 3, number of features."""
    cats = categories or CATEGORIES
    scored = category_scores(df, cats)
    aggs, rows = [], []
    for c, fs in cats.items():
        top = F.col(f"{c}_max")
        aggs += [F.avg(top).alias(f"a_{c}"), F.sum(F.when(top > 3, 1).otherwise(0)).alias(f"n_{c}")]
        rows.append(f"'{c}', a_{c}, n_{c}, {len(fs)}")
    body = ", ".join(rows)
    return scored.agg(*aggs).selectExpr(
        f"stack({len(rows)}, {body}) AS (category, anomaly_score, anomaly_count, feature_count)"
    )


def category_flags(df: DataFrame, categories: dict[str, list[str]], threshold=K.CATEGORY_THRESHOLD) -> DataFrame:
    """Per row and category: is the largest z above the category threshold."""
    scored = category_scores(df, categories)
    return scored.withColumns(
        {f"{c}_flag": F.coalesce(F.col(f"{c}_max") > threshold, F.lit(False)).cast("int") for c in categories}
    )


def top_per_feature(df: DataFrame, features: list[str]) -> DataFrame:
    """The most anomalous row of every feature; the lowest review_id on ties."""
    ids = F.struct("review_id", "reviewer_id", "place_id", "text_quality_risk")
    aggs, rows = [], []
    for f in features:
        z = F.col(f"{f}_anomaly")
        aggs.append(
            F.max_by(
                F.struct(z.alias("score"), ids.alias("ids")),
                F.when(z.isNotNull(), F.struct(z.alias("z"), (-F.col("review_id")).alias("r"))),
            ).alias(f)
        )
        rows.append(f"'{f}_anomaly', `{f}`")
    wide = df.agg(*aggs)
    long = wide.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (feature, top)")
    return long.filter("top IS NOT NULL").select(
        "feature",
        F.col("top.score").alias("max_score"),
        F.col("top.ids.review_id").alias("review_id"),
        F.col("top.ids.reviewer_id").alias("reviewer_id"),
        F.col("top.ids.place_id").alias("place_id"),
        F.col("top.ids.text_quality_risk").alias("quality_risk"),
    )


def model_features(df: DataFrame, others: int | None = None, skip=("review_id", "reviewer_id", "place_id")) -> list[str]:
    """Numeric columns for the model: text-stage ones first, then the others (all, unless a number is given)."""
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType))
        and not f.name.endswith("_anomaly")
        and f.name not in skip
    ]
    text = [c for c in numeric if c.startswith("text_")]
    return text + [c for c in numeric if not c.startswith("text_")][:others]


def clean(value: Column) -> Column:
    """Missing, NaN and infinite values as 0."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(v)


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Model input in trained order: missing columns and values become 0."""
    have = set(df.columns)
    return df.withColumns({f: clean(F.col(f)) if f in have else F.lit(0.0) for f in features})


def standardise(df: DataFrame, features: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    parts = []
    for f in features:
        parts += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    out = df.withColumn("_m", df.agg(F.struct(*parts).alias("m")).scalar())

    def scaled(f: str) -> Column:
        s = F.col(f"_m.s_{f}")
        return (F.col(f) - F.col(f"_m.m_{f}")) / F.when(s > 0, s).otherwise(1.0)

    return out.withColumns({f"{f}{suffix}": scaled(f) for f in features}).drop("_m")


def anomaly_summary(df: DataFrame, features: list[str], flag: str = "ml_anomaly") -> DataFrame:
    return df.agg(
        F.sum(flag).cast("long").alias("anomaly_count"),
        F.avg(flag).alias("anomaly_rate"),
        F.lit(sum(f.startswith("text_") for f in features)).alias("text_feature_count"),
        F.lit(len(features)).alias("total_feature_count"),
    )


def top_features(df: DataFrame, features: list[str], flag: str = "ml_anomaly", k: int = 10) -> DataFrame:
    """Features by |mean| among flagged rows."""
    means = df.filter(F.col(flag) == 1).agg(*[F.abs(F.avg(f)).alias(f) for f in features])
    rows = ", ".join(f"'{f}', `{f}`" for f in features)
    long = means.selectExpr(f"stack({len(features)}, {rows}) AS (feature, importance)")
    return long.filter("importance IS NOT NULL").orderBy(F.desc("importance"), "feature").limit(k)


def top_anomalies(df: DataFrame, score: str = "ml_anomaly_score", k: int = 5) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), "review_id").limit(k)


def flag_share(df: DataFrame, score: str, contamination: float = 0.08, flag: str = "ml_anomaly") -> DataFrame:
    """Flags the ``contamination`` share with the highest score and centres the score on the cut."""
    # The exact quantile: running counts over the distinct scores, wherever the score lies.
    flat = collapse(df.filter(F.col(score).isNotNull()), score, {"n": F.count(F.lit(1))})
    wanted = F.greatest(F.ceil((1 - contamination) * flat.agg(F.sum("n").alias("t")).scalar()), F.lit(1))
    steps = running_sums(flat, score, ["n"]).withColumn("_wanted", wanted)
    cut = steps.filter("cum_n >= _wanted").agg(F.min(score).alias("c")).scalar()
    out = df.withColumn("_cut", cut)
    return out.withColumns(
        {
            flag: (F.col(score) > F.col("_cut")).cast("int"),
            f"{score}_centred": F.col(score) - F.col("_cut"),
        }
    ).drop("_cut")


def text_summary(df: DataFrame) -> DataFrame:
    """Rows, mean confidence, mean risk and rows with risk above 0.7 per text class."""
    return df.groupBy("text_prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("text_confidence").alias("avg_confidence"),
        F.avg("p_bad").alias("avg_quality_risk"),
        F.sum(F.when(F.col("p_bad") > 0.7, 1).otherwise(0)).alias("high_risk"),
    )


def neutral_if_missing(score: Column, default: float = 0.5) -> Column:
    return F.coalesce(score, F.lit(default))
