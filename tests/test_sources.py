import tempfile
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from probity.operators import fusion as M
from probity.operators import scoring as S
from probity.plans import reviews
from probity.plans.catalog import reports
from probity.plans.catalog.models import fusion_rows
from probity.session import checkpoint_dir
from probity.sources import normalise as N
from probity.sources import readers, sinks


@pytest.fixture()
def out():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_csv_with_quotes_and_lines(spark, out):
    with open(f"{out}/a.csv", "w") as f:
        f.write('text,rating,date\n"He said ""hi"",\nthen left",5,2024-01-02\nplain,bad,never\n')
    df = readers.read_table(spark, f"{out}/a.csv", multi_line=True)
    got = N.to_reviews(df).select("text", "stars", F.col("published_at").cast("string").alias("d"), "category").collect()
    assert [tuple(r) for r in got] == [('He said "hi",\nthen left', 5.0, "2024-01-02 00:00:00", None), ("plain", None, None, None)]


def test_large_csv_and_json_lines_are_split(spark, out):
    with open(f"{out}/big.csv", "w") as f:
        f.write("text,rating\n" + "".join(f'"a, ""{i}""",{i % 5}\n' for i in range(40_000)))
    with open(f"{out}/big.jsonl", "w") as f:
        f.write("".join(f'{{"text":"row {i}"}}\n' for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        for name, schema in (("big.csv", "text string, rating string"), ("big.jsonl", "text string")):
            df = readers.read_table(spark, f"{out}/{name}", spark.createDataFrame([], schema).schema)
            assert df.rdd.getNumPartitions() > 3 and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_list_object_and_lines(spark, out):
    for name, body in (("list.json", '[{"text":"a"},{"text":"b"}]'), ("one.json", '{"text":"a"}'), ("rows.jsonl", '{"text":"a"}\n{"text":"b"}\n')):
        with open(f"{out}/{name}", "w") as f:
            f.write(body)
    counts = [readers.read_table(spark, f"{out}/{n}").count() for n in ("list.json", "one.json", "rows.jsonl")]
    assert counts == [2, 1, 2]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "reviews.xlsx")


def test_many_files(spark, out):
    for n in ("a", "b"):
        with open(f"{out}/{n}.csv", "w") as f:
            f.write("text,rating\nx,1\ny,2\n" if n == "a" else "text,rating\nz,3\n")
    df = readers.read_many(spark, [f"{out}/a.csv", f"{out}/b.csv"])
    assert {r.input_file: r.n for r in df.groupBy("input_file").agg(F.count("*").alias("n")).collect()} == {"a.csv": 2, "b.csv": 1}


def test_many_inputs_that_a_job_wrote(spark, out):
    rows = [(1, " two\nlines, \"quoted\" \\ ", "a"), (2, None, "a"), (3, "", "b"), (4, "  ", "b")]
    sinks.write_csv(spark.createDataFrame(rows, "id long, text string, part string"), f"{out}/many", partition_by=["part"])
    df = readers.read_many(spark, f"{out}/many", "id long, text string", multi_line=True, by_folder=True)
    assert sorted((r.id, r.text, r.input_file) for r in df.collect()) == [(i, t or None, f"part={p}") for i, t, p in rows]


def test_empty_and_missing_text_score_alike(spark):
    scored = S.tester_scores(spark.createDataFrame([(1, None, 1.0), (2, "", 1.0)], "id long, text string, stars double"))
    assert scored.select("text_prediction", "fusion_risk_score", "fusion_prediction").distinct().count() == 1


def test_required_column_message(spark):
    with pytest.raises(ValueError, match="available: a, b"):
        N.require_column(spark.createDataFrame([(1, 2)], "a int, b int"), "text")


def test_dropped_rows_are_counted(spark):
    seen = Observation("rows")
    df = spark.createDataFrame([("a",), (None,), (" ",)], "text string")
    assert N.drop_missing_text(df, observation=seen).count() == 2
    assert seen.get == {"rows": 3, "dropped": 1}
    assert N.keep_real_text(df).count() == 1


def test_sample_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "review_id")
    a = {r[0] for r in N.seeded_sample(df, 50).collect()}
    assert len(a) == 50 and a == {r[0] for r in N.seeded_sample(df.repartition(13), 50).collect()}


def test_csv_sink_round_trip(spark, out):
    df = spark.createDataFrame([(1, 'a "q", b\nc', {"k": 0.5})], "review_id long, text string, probs map<string,double>")
    sinks.write_csv(df, f"{out}/res", quote_all=True)
    r = readers.read_csv(spark, f"{out}/res", multi_line=True).first()
    assert r.text == 'a "q", b\nc' and r.probs == '{"k":0.5}'


def test_report_sink(spark, out, catalog, folder):
    sinks.write_report(catalog.queries["tester_report"](spark, folder), f"{out}/report")
    doc = spark.read.json(f"{out}/report").first()
    assert doc.test_info.total_reviews == 1000 and doc.overall_analysis.total_reviews == 1000


@pytest.mark.parametrize("kind,params", [("boosting", {"rounds": 2, "depth": 2}), ("random_forest", {"numTrees": 3, "maxDepth": 3})])
def test_fusion_model_saved_and_loaded(spark, out, folder, kind, params):
    df = fusion_rows(spark, folder)
    model = M.FusionModel(kind, params).fit(df)
    model.save(spark, f"{out}/model")
    again = M.FusionModel.load(spark, f"{out}/model")
    a = {r.review_id: r.final_prediction for r in model.predict(df).collect()}
    assert a == {r.review_id: r.final_prediction for r in again.predict(df).collect()}
    probs = model.predict_with_thresholds(df).select("decision_probs").first()[0]
    assert sum(probs) == pytest.approx(1)


def test_results_per_file_in_parts(spark, folder, catalog, monkeypatch):
    def results():
        return sorted(map(tuple, catalog.queries["results_per_file"](spark, folder).collect()))

    kept = Path(checkpoint_dir(spark).removeprefix("file:"))
    whole, written = results(), []
    monkeypatch.setattr(reviews, "PART_CHARS", 1)
    monkeypatch.setattr(reports, "write_csv", lambda df, path, **more: written.append(path) or sinks.write_csv(df, path, **more))
    assert results() == whole and len(whole) > 1
    assert len(written) > 2 and not list(kept.glob("inputs-*"))  # a part's files go before the next are written
