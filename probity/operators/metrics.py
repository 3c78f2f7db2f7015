"""Evaluation metrics. Every table is reduced to counts per class pair or per distinct score first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.constants import BAD_CLASSES, TEXT_CLASSES
from probity.functions.vectors import label_array
from probity.operators.ordered import collapse, running_sums
from probity.session import cut_lineage


def known_labels(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    return df.filter(F.col(text).isNotNull() & F.col(label).isin(TEXT_CLASSES))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def label_table(spark: SparkSession, labels) -> DataFrame:
    return spark.range(1).select(F.posexplode(label_array(labels)).alias("place", "label"))


def class_distribution(df: DataFrame, label: str, labels=TEXT_CLASSES) -> DataFrame:
    """Count and percentage of every class, also of classes without rows."""
    counts = cut_lineage(df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    out = label_table(df.sparkSession, labels).join(counts, "label", "left").na.fill(0, ["n"])
    return out.select("label", "n", ratio(F.col("n") * 100, total).alias("percent"))


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, truth: str = "truth", predicted: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, truth: str, predicted: str, labels=TEXT_CLASSES, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label; 0 where undefined."""
    by = by or []
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("claimed"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("claimed"), zero.alias("tp")),
    )
    sums = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.label")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "claimed", "tp")])
    )
    if not by:
        sums = label_table(df.sparkSession, labels).join(sums, "label", "left").na.fill(0, ["support", "claimed", "tp"])
    precision = ratio(F.col("tp"), F.col("claimed"))
    recall = ratio(F.col("tp"), F.col("support"))
    out = sums.select(
        *by, "label", precision.alias("precision"), recall.alias("recall"), "support", "claimed", "tp"
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def averages(scores: DataFrame) -> DataFrame:
    """Accuracy, macro, weighted and micro averages over the classes that occur on either side."""
    seen = scores.filter((F.col("support") > 0) | (F.col("claimed") > 0))
    total = F.sum("support")
    cols = [ratio(F.sum("tp"), total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        cols.append(F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}"))
        cols.append(ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}"))
    micro_p, micro_r = ratio(F.sum("tp"), F.sum("claimed")), ratio(F.sum("tp"), total)
    cols += [micro_p.alias("micro_precision"), micro_r.alias("micro_recall")]
    out = seen.agg(*cols, F.count(F.lit(1)).alias("num_classes"), F.coalesce(total, F.lit(0)).alias("total_samples"))
    both = F.col("micro_precision") + F.col("micro_recall")
    return out.withColumn("micro_f1", ratio(2 * F.col("micro_precision") * F.col("micro_recall"), both))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels=TEXT_CLASSES) -> DataFrame:
    """One row per true label and one column per predicted label, in fixed order."""
    counts = pair_counts(df, truth, predicted)
    cells = counts.groupBy("truth").agg(
        *[F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(c) for c in labels]
    )
    rows = label_table(df.sparkSession, labels).withColumnRenamed("label", "truth")
    return rows.join(cells, "truth", "left").drop("place").na.fill(0, list(labels))


def binary_counts(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    def n(a, b):
        return F.coalesce(F.sum(((F.col(y) == a) & (F.col(yhat) == b)).cast("long")), F.lit(0))

    return df.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def binary_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """All rates of a 0/1 prediction from one pass; 0 where a denominator is 0."""
    c = binary_counts(df, y, yhat)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    out = c.withColumns(
        {
            "accuracy": ratio(tp + tn, n),
            "specificity": ratio(tn, tn + fp),
            "sensitivity": ratio(tp, tp + fn),
            "ppv": ratio(tp, tp + fp),
            "npv": ratio(tn, tn + fn),
        }
    )
    spec, sens, ppv, npv = (F.col(x) for x in ("specificity", "sensitivity", "ppv", "npv"))
    out = out.withColumns(
        {
            "genuine_precision": npv,
            "genuine_recall": spec,
            "genuine_f1": ratio(2 * npv * spec, npv + spec),
            "non_genuine_precision": ppv,
            "non_genuine_recall": sens,
            "non_genuine_f1": ratio(2 * ppv * sens, ppv + sens),
        }
    )
    neg, pos = tn + fp, tp + fn
    # A side that occurs neither in truth nor in prediction takes no part in the macro mean.
    g = ((neg > 0) | (tn + fn > 0)).cast("int")
    b = ((pos > 0) | (tp + fp > 0)).cast("int")
    extra = {}
    for m in ("precision", "recall", "f1"):
        gm, bm = F.col(f"genuine_{m}"), F.col(f"non_genuine_{m}")
        extra[f"macro_{m}"] = ratio(gm * g + bm * b, g + b)
        extra[f"weighted_{m}"] = ratio(gm * neg + bm * pos, n)
    return out.withColumns(extra)


def score_steps(df: DataFrame, score: str = "score", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score with running sums from the highest score down."""
    pos = F.sum(F.col(y).cast("long"))
    neg = F.sum((1 - F.col(y)).cast("long"))
    flat = collapse(df, score, {"pos": pos, "neg": neg}, by)
    steps = running_sums(flat, score, ["pos", "neg"], by, descending=True)
    if by:
        totals = flat.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        return steps.join(totals, by)
    total = flat.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    return steps.withColumn("_t", total).withColumns({"_p": F.col("_t.p"), "_n": F.col("_t.n")}).drop("_t")


def _parts() -> dict[str, Column]:
    before = F.col("cum_pos") - F.col("pos")
    before_n = F.col("cum_neg") - F.col("neg")
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    prev_precision = F.when(before + before_n > 0, F.try_divide(before, before + before_n)).otherwise(1.0)
    gain = F.try_divide(F.col("pos"), F.col("_p"))
    return {
        "roc": F.try_divide(F.col("neg") * (before + F.col("pos") / 2), F.col("_p") * F.col("_n")),
        "ap": gain * precision,
        "pr_trapezoid": gain * (precision + prev_precision) / 2,
    }


def ranking_metrics(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """ROC AUC (Mann-Whitney with ties), average precision, and the two trapezoid areas.

    0.5 each when only one class occurs. The ROC trapezoid equals the Mann-Whitney form.
    """
    p = _parts()
    steps = score_steps(df, score, y)
    out = steps.agg(
        F.sum(p["roc"]).alias("roc"), F.sum(p["ap"]).alias("ap"), F.sum(p["pr_trapezoid"]).alias("prt"),
        F.max("_p").alias("p"), F.max("_n").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)

    def pick(c):
        return F.coalesce(F.when(both, F.col(c)), F.lit(0.5))

    return out.select(
        pick("roc").alias("roc_auc"), pick("ap").alias("pr_auc"), pick("roc").alias("roc_trapezoid"),
        pick("prt").alias("pr_trapezoid"),
    )


def curve_points(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    s = score_steps(df, score, y)
    return s.select(
        score,
        ratio(F.col("cum_neg"), F.col("_n")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("_p")).alias("tpr"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )


def class_average_precision(df: DataFrame, truth: str, probs: str, labels=TEXT_CLASSES) -> DataFrame:
    """One-against-rest average precision of every class that occurs, with its support."""
    each = df.select(F.col(truth).alias("truth"), F.posexplode(probs).alias("i", "score"))
    each = each.select(
        F.element_at(label_array(labels), F.col("i") + 1).alias("label"), "score", "truth"
    ).withColumn("y", (F.col("truth") == F.col("label")).cast("int"))
    steps = score_steps(each, "score", "y", by=["label"])
    return (
        steps.groupBy("label")
        .agg(F.sum(_parts()["ap"]).alias("pr_auc"), F.max("_p").alias("support"))
        .filter("support > 0")
    )


def average_precision_means(per_class_ap: DataFrame) -> DataFrame:
    return per_class_ap.agg(
        F.coalesce(F.avg("pr_auc"), F.lit(0.0)).alias("pr_auc_macro"),
        ratio(F.sum(F.col("pr_auc") * F.col("support")), F.sum("support")).alias("pr_auc_weighted"),
    )


def melt(df: DataFrame, columns, name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row table as (name, value) rows."""
    rows = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {rows}) AS ({name}, {value})")


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side with improvement in percent (0 on a zero base) and winner."""
    j = a.withColumnRenamed("value", "model_a").join(b.withColumnRenamed("value", "model_b"), "metric")
    change = F.when(F.col("model_b") > 0, (F.col("model_a") - F.col("model_b")) / F.col("model_b") * 100).otherwise(0.0)
    return j.withColumns(
        {
            "improvement": change,
            "winner": F.when(F.col("model_a") > F.col("model_b"), "model_a").otherwise("model_b"),
        }
    )


def problem_label(label: Column) -> Column:
    return F.coalesce(label.isin(BAD_CLASSES), F.lit(False)).cast("int")


def sample_predictions(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("review_id").alias("sample_id"),
        F.col("truth").alias("true_label_text"),
        F.col("y").alias("true_binary"),
        F.col("yhat").alias("predicted_binary"),
        "probability_non_genuine",
        (F.col("y") == F.col("yhat")).cast("int").alias("correct_prediction"),
    )


def error_row(spark: SparkSession, stage: str, message: str) -> DataFrame:
    """Status row of a stage that failed; joins the stage table like any other."""
    row = [(stage, 0.0, 0.0, message)]
    return spark.createDataFrame(row, "stage string, accuracy double, macro_f1 double, error string")


def attempt(spark: SparkSession, stage: str, build) -> DataFrame:
    """The stage's metrics, or its error row when the plan cannot be built or fails while it runs.

    The few metric rows are stored here, so that a failure shows now and not in whatever reads them.
    """
    try:
        return cut_lineage(build())
    except Exception as e:  # noqa: BLE001 - any failure becomes a status row
        return error_row(spark, stage, str(e))


def with_summary_row(stages: DataFrame, metrics: list[str]) -> DataFrame:
    """Stage rows and a SUMMARY row with the mean of every metric."""
    means = stages.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("stage", F.lit("SUMMARY"))
    return stages.unionByName(means, allowMissingColumns=True)


def title_case(label: Column) -> Column:
    return F.initcap(F.replace(F.replace(label, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))


def three_places(value: Column) -> Column:
    return F.format_number(value, 3)
