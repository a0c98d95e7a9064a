import zlib

import numpy as np
import pytest

from rentlens.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, score double, label int, held_out string"
LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_on_held_out_rows(given):
    documents, labels = given
    scored = quality.score(documents, quality.train(documents, labels))
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert scored.count() == documents.count()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.99
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_toxicity_on_held_out_rows(given):
    documents, labels = given
    scored = toxicity.score(documents, toxicity.train(documents, labels), keep=["doc_id"])
    rows = scored.where("crc32(cast(doc_id as string)) % 5 = 0").join(labels, "doc_id").toPandas()
    assert auc(rows.toxic_score.to_numpy(), rows.toxic.to_numpy()) > 0.95
    assert (rows.toxic_predicted == rows.toxic).mean() > 0.95


def odd_rows(spark):
    rows = [(1, None, "en", 0.1, 1, "x"), (2, "", "en", 0.1, 1, "x"), (None, "a b", None, None, None, None), (3, "word " * 400_000, "en", 0.0, 0, ""), (3, "again", "en", 0.0, 0, ""),
            (4, "x" * 3_000_000, "en", 0.0, 0, ""), (5, "%%% !!\n\n|", "en", 0.0, 0, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(2, 0, 1), (3, 1, 0), (3, 1, 1), (None, 1, 1), (4, None, None)]])
def test_odd_documents_and_few_labels(spark, labels):
    documents, labels = odd_rows(spark), spark.createDataFrame(labels, LABELS)
    scored = quality.score(documents, quality.train(documents, labels)).collect()
    assert len(scored) == 7 and all(0 <= r.score <= 1 for r in scored)
    assert {r.held_out for r in scored if r.doc_id is None} == {False}
    scored = toxicity.score(documents, toxicity.train(documents, labels))
    assert scored.columns == [*documents.columns, "toxic_score", "toxic_predicted"]
    assert all(0 <= r.toxic_score <= 1 for r in scored.collect())
    none = documents.limit(0)
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, given):
    documents, labels = given
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality",
                                "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    small = documents.limit(300).persist()
    a = quality.score(small, quality.train(documents, labels, limit=1000)).orderBy("doc_id").collect()
    b = quality.score(small, quality.train(documents, flipped, limit=1000)).orderBy("doc_id").collect()
    assert a == b


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9
