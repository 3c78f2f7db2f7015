import gc
import json
from datetime import datetime

from pyspark.sql import functions as F

from probity.constants import PROMPT_HEAD, PROMPT_TAIL
from probity.operators import labeling as L
from probity.plans import reviews as P
from probity.plans.catalog import labels
from probity.schema import MODEL_RESPONSES


def test_parse_edges(spark):
    ok = json.dumps([{"classification": "spam", "confidence": 1, "reasoning": "r"}, {"classification": "what", "confidence": "0.9"}])
    rows = [
        (1, f"Here:\n{ok}\nbye", 2), (2, ok[:30], 2), (3, ok, 3), (4, "nothing", 1), (5, "[]", 1),
        (6, '[{"confidence": null}]', 1),
    ]
    df = spark.createDataFrame(rows, "id int, response string, n int")
    got = {r.id: [tuple(a) for a in r.a] for r in df.select("id", L.parse_response(F.col("response"), F.col("n")).alias("a")).collect()}
    failed = ("spam", 0.0, "Parse error - default classification")
    assert got[1] == [("spam", 1.0, "r"), ("spam", 0.5, "Automatic classification")]
    assert got[2] == [failed] * 2 and got[3] == [failed] * 3 and got[4] == [failed] and got[5] == [failed]
    assert got[6] == [("spam", 0.5, "Automatic classification")]


def test_fail_over_and_defaults(spark):
    batches = spark.createDataFrame([(i, i // 2, i % 2) for i in range(5)], "review_id long, batch_id long, pos int")
    one = '[{"classification":"irrelevant","confidence":0.4,"reasoning":"x"}]'
    two = '[{"classification":"spam","confidence":0.4,"reasoning":"x"},{"classification":"fake_rant","confidence":0.6,"reasoning":"y"}]'
    responses = spark.createDataFrame(
        [(0, "a", 0, False, None), (0, "b", 1, True, two), (2, "a", 0, True, one), (2, "b", 1, True, two)], MODEL_RESPONSES
    )
    got = {r.review_id: r for r in L.label_rows(batches, responses).collect()}
    assert (got[0].label_class, got[1].label_class, got[0].label_provider) == ("spam", "fake_rant", "b")
    assert (got[4].label_class, got[4].label_provider) == ("irrelevant", "a")
    assert got[2].label_reasoning == "All providers failed" and got[3].label_provider == "none" and got[3].fake_review == 1


def test_asking_providers(spark):
    def limited(prompt):
        raise RuntimeError("429 rate limit")

    def broken(prompt):
        raise RuntimeError("odd failure")

    table = spark.createDataFrame([(1, "p")], "batch_id long, prompt string")
    rows = L.ask_providers(table, [L.Provider("x", limited), L.Provider("y", broken), L.Provider("z", lambda p: "[]"), L.Provider("w", str)])
    assert [(r.provider, r.ok) for r in rows.orderBy("rank").collect()] == [("x", False), ("y", False), ("z", True)]


def test_prompt_text(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 1001), (3, "  "), (4, None)], "review_id long, text string")
    batches = L.in_batches(df)
    p = L.prompts(batches).collect()
    assert len(p) == 1 and p[0].expected == 2
    assert p[0].prompt == PROMPT_HEAD + '\n1. "short"\n' + '\n2. "' + "x" * 1000 + '..."\n' + PROMPT_TAIL


def test_query_shows_whole_texts(spark, tmp_path, catalog):
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(i, day, 1, "view", 2.0, '{"k": 1}') for i in (11, 31)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("one", "two"):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "events.parquet").symlink_to(tmp_path / "events.parquet")
        rows = [(i, "a" * 1400 + name, "en", "web") for i in range(20)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    one, two = (catalog.queries["label_prompts"](spark, str(tmp_path / n)).collect() for n in ("one", "two"))
    # The texts differ behind their thousandth character only.
    assert len(one) == len(two) == 1 and one[0].expected == 2 and one[0].prompt_digest != two[0].prompt_digest


def shuffled(spark):
    """Bytes of shuffle files that are on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def test_prompts_in_parts_leave_no_shuffles(spark, folder, catalog, monkeypatch):
    whole = L.prompts(L.in_batches(P.reviews(spark, folder)), limit=None).select("batch_id", "expected", F.md5("prompt"))
    wanted = sorted(map(tuple, whole.collect()))
    gc.collect()
    monkeypatch.setattr(P, "PART_CHARS", 1)
    columns, stored = [], labels.cut_lineage
    monkeypatch.setattr(labels, "cut_lineage", lambda df: columns.append(df.columns) or stored(df))
    before = shuffled(spark)
    found = catalog.queries["label_prompts"](spark, folder)
    assert columns[0] == ["review_id", "_text", "_tail", "_length", "batch_id", "pos"]  # ordered and numbered without texts
    texts = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert len(columns) > 4 and shuffled(spark) - before < texts / 10
    assert sorted(map(tuple, found.collect())) == wanted
