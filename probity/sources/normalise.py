"""From whatever columns a table has to the canonical review schema. Choices are made on column names
when the plan is built; values that cannot be read become NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity import constants as K
from probity.functions.text import measure, measured
from probity.operators.ordered import global_row_number
from probity.schema import REVIEW


def require_column(df: DataFrame, column: str) -> DataFrame:
    """Checked before any job runs; the message lists the first ten columns there are."""
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found; available: {', '.join(df.columns[:10])}")
    return df


def drop_missing_text(df: DataFrame, text: str = "text", observation=None) -> DataFrame:
    """Rows with text. An ``Observation`` receives the number of dropped rows without a job of its own."""
    if observation is not None:
        df = df.observe(
            observation, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(text).isNull(), 1)).alias("dropped")
        )
    return df.filter(measure("length").isNotNull() if measured(df, text) else F.col(text).isNotNull())


def keep_real_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is more than white space."""
    return df.filter(measure("words") > 0 if measured(df, text) else F.col(text).rlike(r"(?U)\S"))


def first_rows(df: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def seeded_sample(df: DataFrame, n: int, key: str = "review_id", seed: int = 42) -> DataFrame:
    """min(n, rows) rows, the same ones on every run."""
    u = F.xxhash64(key, F.lit(seed))
    return df.withColumn("_u", u).orderBy("_u", key).limit(n).drop("_u")


def number(value: Column) -> Column:
    v = value.try_cast("double")
    return F.when(~F.isnan(v), v)


def timestamp(value: Column) -> Column:
    """Timestamps in UTC; what is no time becomes NULL."""
    return value.try_cast("timestamp")


def first_present(df: DataFrame, names, default: Column | None = None) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n)
    return default if default is not None else F.lit(None).cast("string")


def rating_column(df: DataFrame) -> str | None:
    """The first column whose name speaks of rating or stars."""
    for c in df.columns:
        if "rating" in c.lower() or "star" in c.lower():
            return c
    return None


def training_rating(df: DataFrame) -> Column:
    """rating, else llm_rating, else 3.0."""
    for name in ("rating", "llm_rating"):
        if name in df.columns:
            return number(F.col(name))
    return F.lit(3.0)


def with_row_ids(df: DataFrame, order: Column, tie: str, column: str = "review_id") -> DataFrame:
    """Adds 0-based row numbers in a stated order where the table has no ids of its own."""
    out = global_row_number(df, order, tie, "_rn")
    return out.withColumn(column, F.col("_rn") - 1).drop("_rn")


def fill_metadata(df: DataFrame) -> DataFrame:
    """Default metadata: place from the business name, reviewer and review ids from the row number,
    fixed date, ten earlier reviews, no guide, no likes. Needs ``row_number`` on the row."""
    have = set(df.columns)

    def old(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    rn = F.col("row_number").cast("string")
    business = old("business_name", "string")
    return df.withColumns(
        {
            "place_id": F.coalesce(old("place_id", "string"), business, F.lit(K.UNKNOWN_BUSINESS)),
            "reviewer_id": F.coalesce(old("reviewer_id", "string"), F.concat(F.lit("user_"), rn)),
            "review_key": F.coalesce(old("review_key", "string"), F.concat(F.lit("review_"), rn)),
            "published_at": F.coalesce(old("published_at", "timestamp"), F.lit(K.DEFAULT_PUBLISHED).cast("timestamp")),
            "reviewer_review_count": F.coalesce(old("reviewer_review_count", "bigint"), F.lit(K.DEFAULT_REVIEW_COUNT).cast("bigint")),
            "is_local_guide": F.coalesce(old("is_local_guide", "boolean"), F.lit(False)),
            "likes_count": F.coalesce(old("likes_count", "bigint"), F.lit(0).cast("bigint")),
        }
    )


NAMES = {
    "text": ["text", "review_text", "reviewText"],
    "stars": K.COLUMN_ALIASES["stars"],
    "published_at": ["published_at", "publishedAtDate", "publishAt", *K.COLUMN_ALIASES["published_at"]],
    "reviewer_id": ["reviewer_id", "reviewerId"],
    "place_id": ["place_id", "placeId"],
    "original_language": ["original_language", "originalLanguage"],
    "review_image_urls": ["review_image_urls", "reviewImageUrls"],
    "reviewer_review_count": ["reviewer_review_count", "reviewerNumberOfReviews"],
    "is_local_guide": ["is_local_guide", "isLocalGuide"],
    "likes_count": ["likes_count", "likesCount"],
    "category": ["category", "business_category"],
    "helpful_votes": ["helpful_votes", *K.COLUMN_ALIASES["helpful_votes"]],
    "label": ["label", "llm_classification"],
}


def to_reviews(df: DataFrame, text_column: str | None = None) -> DataFrame:
    """The canonical schema: aliases resolved, values cast without failing, absent columns typed NULL."""
    out = []
    for f in REVIEW.fields:
        names = [text_column] if f.name == "text" and text_column else NAMES.get(f.name, [f.name])
        value = first_present(df, names)
        if isinstance(f.dataType, T.DoubleType):
            value = number(value)
        elif isinstance(f.dataType, T.TimestampType):
            value = timestamp(value)
        elif isinstance(f.dataType, T.StringType):
            value = value.cast("string")
        else:
            value = value.try_cast(f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)
