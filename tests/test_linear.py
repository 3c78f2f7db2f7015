"""The sparse scorer against the library's own model."""

import random

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from probity.operators import linear
from probity.operators import textmodel as T

CLASSES = ["genuine_positive", "genuine_negative", "spam", "fake_rant"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    own = {c: [f"{c[:3]}{i}" for i in range(12)] for c in CLASSES}
    shared = ["the", "Soup", "soup", "été", "x_1", "2024", "KK", "don't", "ab", "abc", "abcde"]
    out = []
    for i in range(240):
        label = draw.choice(CLASSES)
        words = draw.choices(own[label], k=draw.randrange(6)) + draw.choices(shared, k=draw.randrange(8))
        draw.shuffle(words)
        out.append((i, draw.choice([" ", "-", "\n"]).join(words), label))
    out += [(900, None, "spam"), (901, "", "spam"), (902, "...", None), (903, "soup spa3 " * 30_000, None), (904, "never seen", None)]
    return spark.createDataFrame(out, "review_id long, text string, label string")


def both(rows, model):
    a = {r.review_id: r for r in linear.sparse_scores(rows, model, batch_size=7).collect()}
    b = {r.review_id: r for r in T.text_model_scores(rows, model).collect()}
    return a, b


@pytest.mark.parametrize("width", [1 << 16, 32])
def test_equals_library_model(rows, width):
    a, b = both(rows, T.train_text_model(rows, iterations=8, features=width))
    assert sorted(a) == sorted(b)
    for k in a:
        assert a[k].probs == pytest.approx(b[k].probs, abs=1e-6)
        assert a[k].p_bad == pytest.approx(b[k].p_bad, abs=1e-6)
        assert (a[k].text, a[k].label, a[k].model_type) == (b[k].text, b[k].label, b[k].model_type)
        top = sorted(b[k].probs)
        if top[-1] - top[-2] > 1e-6:
            assert a[k].text_prediction == b[k].text_prediction


def test_hash_is_the_library_one():
    words = ["", "a", "ab", "abc", "abcd", "abcde", "été", "日本語", "x" * 1001]
    tf = HashingTF(numFeatures=1 << 20)
    assert [linear.murmur3(w.encode()) % (1 << 20) for w in words] == [tf.indexOf(w) for w in words]


def test_large_model_goes_to_the_library(rows, monkeypatch):
    model = T.train_text_model(rows, iterations=2, features=64)
    monkeypatch.setattr(linear, "WEIGHT_BYTES", 0)
    out = linear.sparse_scores(rows, model)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    monkeypatch.undo()
    assert "ArrowEvalPython" in linear.sparse_scores(rows, model)._jdf.queryExecution().toString()


def test_memory_of_words_starts_anew(rows, monkeypatch):
    model = T.train_text_model(rows, iterations=2, features=64)
    scorer = linear.SparseScorer.of(model)
    texts = [r.text or "" for r in rows.filter("review_id < 60").collect()]
    want = scorer.logits(texts, {})
    monkeypatch.setattr(linear, "KEPT_WORDS", 3)
    memory: dict[str, int] = {}
    assert (scorer.logits(texts, memory) == want).all()
    assert len(memory) <= 3
    assert scorer.logits([], {}).shape == (0, 7)


def test_empty_table(rows):
    model = T.train_text_model(rows, iterations=2, features=64)
    assert linear.sparse_scores(rows.filter(F.lit(False)), model).count() == 0
