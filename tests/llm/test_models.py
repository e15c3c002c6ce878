"""The classifiers: held-out accuracy, and rows that are no ordinary texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language, quality
from lodestrata.llm.common import held_out

ODD = [(1, None), (2, ""), (3, " 12 !? "), (None, "the and of"), (4, "word " * 30_000), (4, "word " * 30_000), (5, "퟿ 漢字")]


def test_folds(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_language(larger, docs_of):
    docs, _ = larger
    model = language.trained(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] >= 0.97 and 0 <= got[1] <= got[2] <= 1
    odd = language.identify(docs_of(ODD), model).collect()
    assert len(odd) == len(ODD) and all(r.lang_pred == "und" for r in odd if r.doc_id in (1, 2, 3)) and {r.lang_pred for r in odd if r.doc_id is None} == {"en"}
    assert language.identify(docs_of([]), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs_of(ODD), language.fit([])).collect()} == {"und"}


def test_backoff():
    model = language.fit([("a", "anna banana"), ("b", "otto motto")])
    assert np.argmax(model.word_scores("anna")) == 0 and np.argmax(model.word_scores("lotto")) == 1 and np.argmax(model.word_scores("nana")) == 0


def test_training_sample_is_bounded_and_labelled(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else None if i % 2 else "de") for i in range(90)]
    got = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "doc_id", "text", 5).collect()
    assert sorted(r.lang for r in got) == ["de"] * 5 + ["en"] * 5 and all(zlib.crc32(r.text[1:].encode()) % 3 != 1 for r in got)


def test_quality(larger, docs_of):
    docs, labels = larger
    model = quality.trained(docs, labels)
    scored = quality.score_documents(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in scored]
    assert sum(right) >= 0.93 * len(right) and all(0 <= r.score <= 1 for r in scored)
    odd = quality.score_documents(docs_of(ODD), model, keep_row=True).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and odd[0].row.asDict().keys() >= {"spans", "h"}
    assert quality.score_documents(docs_of([]), model).count() == 0


def test_no_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(None, 1), (2, None), (4, 1)], "doc_id long, quality int")
    for labels in (none, one):
        assert quality.score_documents(docs_of(ODD), quality.trained(docs_of(ODD), labels)).count() == len(ODD)


def test_gradients():
    """The fit lowers the loss of bags that only one passage tells apart."""
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for k in range(80):
        x = rng.normal(size=(6, quality.FEATURES)).astype(np.float32)
        if k % 2:
            x[rng.integers(6), 0] += 6
        bags.append(x)
        labels.append(k % 2)
    model = quality.fit(bags, np.array(labels, float))
    scaled = np.clip((np.concatenate(bags) - model.mean) / model.scale, -8, 8)
    score = quality._attention(model, scaled, np.repeat(np.arange(80), 6), 80)[-1]
    assert ((score >= 0.5) == np.array(labels, bool)).mean() >= 0.95
