"""Ids above 2^53 beside nulls in one batch, through every Python stage."""

from __future__ import annotations

import pytest

from veilmark.llm import quality
from veilmark.llm.language_id import identify, learn
from veilmark.llm.ngram_join import ngram_jaccard_join
from veilmark.llm.packing import pack_documents
from veilmark.llm.quality import score_documents, train
from veilmark.llm.shared import new_path
from veilmark.llm.token_files import read_token_files, write_token_files

BIG = (1 << 53) + 1
TEXT = "alpha beta gamma delta epsilon zeta"


@pytest.fixture(scope="module")
def rows(spark):
    kept = [(None, "one two three four five six", "en"), (BIG, TEXT, "en"), (None, None, None), (BIG + 2, TEXT, "fr"), (7, "wort eins zwei drei vier", "fr")]
    return spark.createDataFrame(kept, "doc_id long, text string, lang string").coalesce(1).cache()


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect())


WANT = [-1, -1, 7, BIG, BIG + 2]


def test_ids_keep_their_digits(spark, rows):
    folder = new_path(spark, "token-files")
    assert ids(pack_documents(rows)) == WANT
    assert ids(read_token_files(write_token_files(rows, folder), folder)) == WANT
    assert ids(identify(rows, learn(rows))) == WANT
    labels = spark.createDataFrame([(BIG, 1), (7, 0), (BIG + 2, 1)], "doc_id long, quality int")
    assert ids(score_documents(rows, train(rows, labels, "quality"))) == WANT


def test_links_of_large_ids(rows):
    found = {(r["doc_id"], r["component_id"]) for r in ngram_jaccard_join(rows).collect()}
    assert found == {(None, None), (BIG, BIG), (BIG + 2, BIG), (7, 7)}


def test_training_rows_are_bounded(spark, monkeypatch):
    """5,000 rows of one doc_id are one row to learn from, and the limit holds."""
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: sizes.append(len(rows)))
    docs = spark.range(5_000).selectExpr("0L as doc_id", "concat('word ', id) as text").union(spark.range(1, 9).selectExpr("id", "'some words'"))
    labels = spark.range(9).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    for limit, want in ((2, 2), (100, 9)):
        train(docs, labels, "quality", limit=limit)
        assert sizes.pop() == want
    monkeypatch.setattr(quality, "FEATURES", 20)
    train(docs, labels, "quality")
    assert 0 < sizes.pop() < 9
