"""Rules that need the profiles of reviewer and business beside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.profiles import enrich
from probity.session import cut_lineage


def moderation_flags(
    df: DataFrame, confidence: float = 0.8, risk: float = 0.7, user_risk: float = 0.5, alert: float = 0.5
) -> DataFrame:
    """Review, reviewer and business flags from text risk, anomaly flag and mean risks per key."""
    slim = df.select("review_id", "reviewer_id", "place_id", "text_confidence", "p_bad", "metadata_is_anomaly")
    slim = cut_lineage(slim)  # read by both profiles and by the rows themselves
    users = slim.groupBy("reviewer_id").agg(F.avg("p_bad").alias("user_avg_risk"))
    places = slim.groupBy("place_id").agg(F.avg("p_bad").alias("business_avg_risk"))
    out = enrich(enrich(slim, users, "reviewer_id"), places, "place_id")
    return out.withColumns(
        {
            "flag_for_review": ((F.col("text_confidence") > confidence) & (F.col("p_bad") > risk)).cast("int"),
            "investigate_user": ((F.col("user_avg_risk") > user_risk) & F.col("metadata_is_anomaly")).cast("int"),
            "alert_business": (F.col("business_avg_risk") > alert).cast("int"),
        }
    )
