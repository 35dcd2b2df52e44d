"""Very many rows of one id: bounded samples, flat lists, whole results."""

import pytest

from tidemark.llm import chunk_dedup, fingerprints, ngram_join, toxicity

TEXT = "the quick brown fox jumps over the lazy dog and runs away from the farm "


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(7, TEXT + "x" * (i % 3)) for i in range(10_000)] + [(i, TEXT + f"word{i}") for i in range(8, 40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_training_sample_is_bounded(spark, repeated, monkeypatch):
    seen = {}

    def fit(word, row, fold, labels, folds=toxicity.FOLDS):
        seen["rows"], seen["words"] = len(fold), len(word)
        return []

    monkeypatch.setattr(toxicity, "fit_chain", fit)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(7, 40)] * 3, "doc_id long, quality int, toxic int")
    toxicity.train(repeated, labels, rows=10)
    assert seen["rows"] == 10
    assert seen["words"] < 10 * 20


def test_substring_lists_do_not_grow(repeated):
    earlier = repeated.sparkSession.createDataFrame([(1, TEXT * 6)], "doc_id long, text string")
    long = repeated.sparkSession.createDataFrame([(7, TEXT * 6)] * 5_000, "doc_id long, text string")
    rows = chunk_dedup.substring_dedup(earlier.unionByName(long)).where("doc_id = 7").groupBy("text", "n_removed").count().collect()
    assert len(rows) == 1 and rows[0]["count"] == 5_000


def test_ngram_join(repeated):
    rows = ngram_join.ngram_jaccard(repeated, size=3, num=1, den=2).collect()
    assert len(rows) == 10_032
    assert {r.component_id for r in rows} == {7}


def test_fingerprints(repeated):
    assert fingerprints.edited_pairs(repeated).count() == 10_032
