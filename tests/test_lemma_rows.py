"""The rows of a lemma join are the same whichever way a table of its size is used."""

import pytest

from ratingloom.functions import text as tx

ROWS = [(1, ["cats", "ran"]), (1, ["dogs", "cats"]), (1, ["dogs", "cats"]), (2, []), (3, None), (None, ["ran", None]), (4, ["x"])]


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_a_row_for_each_row(spark, tiny_limits, most):
    rows = spark.createDataFrame(ROWS, "id bigint, w array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "form string, lemma string")
    got = [(r["id"], r["w"]) for r in tx.lemmatised(rows, "id", "w", lemmas, most).collect()]
    change = {"cats": "cat", "ran": "run"}
    want = [(i, None if w is None else [change.get(t, t) for t in w]) for i, w in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_prepared_rows_that_share_a_key(spark, monkeypatch, most):
    monkeypatch.setattr(tx._with_lemmas, "__defaults__", (most,))
    rows = spark.createDataFrame([(1, "cats play", ""), (1, "dogs ran", ""), (2, "", "")], "id bigint, text string, summary string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "form string, lemma string")
    got = [(r["id"], r["text"].split()) for r in tx.prepare(rows, "id", lemmas=lemmas).select("id", "text").collect()]
    assert sorted(got) == [(1, ["cat", "play"]), (1, ["dogs", "run"]), (2, [])]
