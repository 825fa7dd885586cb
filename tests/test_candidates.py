"""Candidates of users: built behind one shuffle of packed neighbour lists, only the best ones written."""

import pytest
from data import frame
from pyspark.sql import functions as F

from ratingloom.operators import recommend as rec
from ratingloom.operators import similarity as sims


def fitted(spark, k=4):
    df = frame(spark)
    return df, rec.fit(df, rec.Settings(similarity_method="jaccard", k=k, use_idf_weighting=False))


def built(frame_):
    above, found, _ = frame_._jdf.queryExecution().executedPlan().toString().partition("Generate inline")
    assert found
    return above


def test_candidates_are_not_shuffled_after_they_are_built(spark):
    df, model = fitted(spark)
    assert "Exchange" not in built(rec.scored_candidates(rec.history_cells(df), model.sim))


def test_common_pairs_are_not_shuffled_after_they_are_built(spark):
    assert "Exchange" not in built(sims.common_rater_statistics(frame(spark).dropDuplicates(["user_id", "item_id"])))


def test_candidates_are_the_unseen_neighbours(spark, tiny_limits):
    df, model = fitted(spark)
    history = rec.history_cells(df)
    sim = {(r["item_id"], r["neighbor"]): r["sim"] for r in model.sim.collect()}
    want, seen = {}, {(r["user_id"], r["item_id"]) for r in history.collect()}
    for r in history.collect():
        for (item, other), s in sim.items():
            if item == r["item_id"] and (r["user_id"], other) not in seen:
                total, near = want.get((r["user_id"], other), (0.0, 0.0))
                want[r["user_id"], other] = (total + s * r["weight"], max(near, s if r["recent"] else 0.0))
    got = {(r["user_id"], r["item_id"]): (r["score"], r["closeness"]) for r in
           rec.scored_candidates(history, model.sim, model.heavy_items).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_only_the_best_candidates_are_written(spark, tiny_limits):
    df, model = fitted(spark)
    ready = rec.prepare(model, df, 1)
    every = rec.scored_candidates(ready.history, model.sim).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    kept = {r["user_id"]: r["n"] for r in ready.found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r["user_id"]: r["n"] for r in every.collect()}
    assert max(sizes.values()) > 2 and kept == {u: min(n, 2) for u, n in sizes.items()}
    with pytest.raises(ValueError):
        rec.finish(model, ready, 2)
