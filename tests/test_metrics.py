import random

import pytest
from pyspark.sql import functions as F

from probity.constants import TEXT_CLASSES
from probity.operators import complement as C
from probity.operators import metrics as E
from probity.operators import reports as B


def auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(rows):
    total, out, last = sum(y for _, y in rows), 0.0, 0.0
    for cut in sorted({s for s, _ in rows}, reverse=True):
        kept = [y for s, y in rows if s >= cut]
        recall = sum(kept) / total
        out += (recall - last) * sum(kept) / len(kept)
        last = recall
    return out


@pytest.mark.parametrize("places", [1, 6])
def test_ranking_against_brute_force(spark, places):
    rng = random.Random(places)
    rows = [(round(rng.random(), places), int(rng.random() < 0.3)) for _ in range(300)]
    r = E.ranking_metrics(spark.createDataFrame(rows, "score double, y int")).first()
    assert r.roc_auc == pytest.approx(auc(rows)) and r.pr_auc == pytest.approx(average_precision(rows))


@pytest.mark.parametrize("y", [0, 1])
def test_one_class_only(spark, y):
    df = spark.createDataFrame([(0.1, y), (0.7, y)], "score double, y int").withColumn("yhat", F.col("y"))
    r = E.ranking_metrics(df).first()
    assert r.roc_auc == r.pr_auc == 0.5
    b = E.binary_metrics(df).first()
    assert (b.tn, b.fp, b.fn, b.tp) == ((2, 0, 0, 0) if y == 0 else (0, 0, 0, 2))
    assert b.accuracy == 1 and b.macro_f1 == 1
    assert b.sensitivity == y and b.specificity == 1 - y


def test_absent_classes_are_zero(spark):
    df = spark.createDataFrame([("spam", "spam"), ("spam", "irrelevant")], "truth string, prediction string")
    pc = {r.label: r for r in E.per_class(df, "truth", "prediction").collect()}
    assert len(pc) == 7 and pc["spam"].recall == 0.5 and pc["irrelevant"].precision == 0 and pc["fake_rant"].support == 0
    a = E.averages(E.per_class(df, "truth", "prediction")).first()
    assert a.num_classes == 2 and a.accuracy == 0.5 and a.macro_recall == 0.25
    m = {r.truth: r for r in E.confusion_matrix(df, "truth", "prediction").collect()}
    assert m["spam"]["irrelevant"] == 1 and sum(m["fake_rant"][c] for c in TEXT_CLASSES) == 0


def test_complement_without_problems(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "y int, stage1 int, stage2 int")
    r = C.complement_metrics(df).first()
    assert r.stage1_coverage == 0 and r.stage2_recovery_rate == 0 and r.overall_agreement == 0.5
    assert r.false_positive_increase == 0.5 and r.combined_and_precision == 0


def test_empty_batch_summary(spark):
    df = spark.createDataFrame([], "is_error boolean, final_prediction string, final_confidence double, p_bad double")
    r = B.batch_summary(df).first()
    assert (r.total, r.processed, r.avg_confidence, r.genuine_percentage) == (0, 0, 0, 0)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (None,)], "x double")
    assert sum(r.n for r in B.histogram(df, "x").collect()) == 2


def test_stage_error_row(spark):
    def broken():
        raise RuntimeError("no model")

    r = E.attempt(spark, "Stage 2", broken).first()
    assert r.stage == "Stage 2" and r.error == "no model"


def test_stage_that_fails_while_it_runs(spark):
    late = lambda: spark.range(1).selectExpr("'Stage 3' stage", "assert_true(id > 5, 'lost model') x", "1.0 accuracy")
    r = E.attempt(spark, "Stage 3", late).first()
    assert r.stage == "Stage 3" and "lost model" in r.error
