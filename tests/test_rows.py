"""Cleaning, splits, training sets, rating prediction, diagnostics."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import frame, interactions
from ratingloom.functions import skew
from ratingloom.operators import cleaning, diagnostics, rating_models, splits, training_sets
from ratingloom.operators.item_features import item_aggregates, metadata_features, scaled
from ratingloom.operators.similarity import common_rater_similarity

ROWS = interactions(rows=120)


def test_blank_and_unknown_ids(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("", "x"), ("a", ""), ("unknown", "x"), ("b", None)], "user_id string, item_id string")
    assert cleaning.drop_blank_ids(df).count() == 2
    assert cleaning.drop_unknown_ids(df).count() == 3


def test_guards(spark):
    with pytest.raises(ValueError):
        cleaning.require_rows(frame(spark, ROWS[:10]), 50)
    empty = spark.createDataFrame([("unknown", "x", 1.0, 0, "r")], "user_id string, item_id string, rating double, ts bigint, row_key string")
    with pytest.raises(ValueError):
        cleaning.preserving_core(empty)


@pytest.mark.parametrize("cut", [splits.flag_stratified, splits.flag_shuffled])
def test_stratified_split_sizes(spark, tiny_limits, cut):
    per_user = Counter(r[0] for r in ROWS)
    flagged = cut(frame(spark, ROWS)).collect()
    assert len(flagged) == len(ROWS)
    tests = Counter(r["user_id"] for r in flagged if r["is_test"])
    for user, n in per_user.items():
        assert tests[user] == (0 if n < 3 else max(1, min(int(n * 0.2), n - 2)))


def test_temporal_split_keeps_known_items_only(spark, tiny_limits):
    train, test = splits.temporal_split(frame(spark, ROWS))
    known = {r["item_id"] for r in train.collect()}
    assert all(r["item_id"] in known for r in test.collect())
    assert min(Counter(r["user_id"] for r in train.collect()).values()) >= 3


def test_folds_and_all_but_n(spark, tiny_limits):
    folds = Counter(r["fold"] for r in splits.contiguous_folds(frame(spark, ROWS), ["ts", "row_key"]).collect())
    assert folds == {i: 24 for i in range(5)}
    flagged = splits.all_but_n(frame(spark, ROWS), 2, 3, 5).collect()
    assert len(flagged) == len(ROWS) and sum(r["is_test"] for r in flagged) == 5


def test_negatives_are_unseen_and_complete(spark, tiny_limits):
    rows = training_sets.encoded(frame(spark, ROWS))
    n_items = len({r[1] for r in ROWS})
    seen = defaultdict(set)
    for r in rows.collect():
        seen[r["user_idx"]].add(r["item_idx"])
    got = training_sets.negatives(rows, 4).collect()
    assert len(got) == 4 * len(ROWS)
    for r in got:
        assert 0 <= r["item_idx"] < n_items
        if len(seen[r["user_idx"]]) < n_items:
            assert r["item_idx"] not in seen[r["user_idx"]]
    spread = {r["item_idx"] for r in got}
    assert spread >= {i for i in range(n_items) if any(i not in s for s in seen.values())}


def test_user_batches(spark):
    got = training_sets.user_batches(frame(spark, ROWS), 8, 4).collect()
    per = Counter((r["batch_id"], r["user_id"]) for r in got)
    assert set(per.values()) == {4} and set(Counter(b for b, _ in per).values()) == {2}


def test_validate_samples_rejects_wrong_types(spark):
    good = training_sets.training_set(frame(spark, ROWS), 1)
    row = training_sets.validate_samples(good).first()
    assert row["n_samples"] == 240 and row["n_null"] == 0
    with pytest.raises(ValueError):
        training_sets.validate_samples(good.withColumn("label", F.col("label").cast("int")))


def test_knn_with_means_golden_value(spark):
    # The worked example of five users and two items.
    rows = [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 2.0), ("B", 2, 4.0), ("C", 1, 2.5), ("C", 2, 4.0), ("D", 1, 4.5), ("D", 2, 5.0), ("E", 1, 3.0)]
    ratings = spark.createDataFrame(rows, "user_id string, item_id int, rating double")
    sim = common_rater_similarity(ratings)
    assert abs(sim.first()["sim"] - 0.969547) < 1e-6
    wanted = spark.createDataFrame([("E", 2)], "user_id string, item_id int")
    assert abs(rating_models.knn_with_means(ratings, wanted, sim).first()["estimate"] - 4.15) < 1e-9


def test_factor_model_beats_the_scale_middle(spark):
    cells = frame(spark, ROWS).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    out = rating_models.factor_predictions(cells, cells, rank=3, epochs=5, reg=0.1)
    errors = [(abs(r["estimate"] - r["rating"]), abs(3 - r["rating"])) for r in out.collect()]
    assert all(1 <= r["estimate"] <= 5 for r in out.collect())
    assert sum(e for e, _ in errors) < sum(m for _, m in errors)


def test_issue_texts_and_advice(spark):
    rows = [(i, i, 5.0, 1_000_000_000, f"r{i}") for i in range(60)] + [(0, 0, 5.0, 1_000_000_000, "dup")]
    stats = diagnostics.statistics(frame(spark, rows))
    texts = [r["issue"] for r in diagnostics.issues(stats).orderBy("pos").collect()]
    assert texts[0] == "Found 1 duplicate user-item interactions"
    assert "High rating bias detected (>60% ratings are 5.0)" in texts
    assert any(t.startswith("Very short time span (0 days)") for t in texts)
    assert any(t.startswith("High cold-start user ratio: 98.3%") for t in texts)
    cats = [r["category"] for r in diagnostics.advice(diagnostics.issues(stats)).orderBy("pos").collect()]
    assert "Cold Start Handling" in cats and "Popularity Bias" in cats


def test_single_rating_items_use_the_defaults(spark):
    rows = spark.createDataFrame([(1, 4.0, 0.5, True, 0.5), (2, 2.0, 1.0, False, 0.5), (2, 4.0, 0.0, True, 0.5)],
                                 "item_id bigint, rating double, helpfulness double, verified boolean, user_expertise double")
    meta = {r["item_id"]: r for r in metadata_features(item_aggregates(rows)).collect()}
    assert meta[1]["rating_steady"] == 0.5 and meta[1]["help_steady"] == 0.5
    flat = {r["item_id"]: r for r in scaled(metadata_features(item_aggregates(rows))).collect()}
    assert flat[1]["expertise"] == 0.0 and flat[2]["expertise"] == 0.0


@pytest.mark.parametrize("preserving", [True, False])
def test_core_rounds_see_ids_only(spark, tiny_limits, monkeypatch, preserving):
    """Whole rows are written once, before the rounds, and the result is that of rounds over whole rows."""
    wide, cut = [], cleaning.durable
    monkeypatch.setattr(cleaning, "durable", lambda df: wide.append("rating" in df.columns) or cut(df))
    rows = interactions(seed=4, users=30, items=25, rows=260, hot=0.1)
    rest = rows
    if preserving:
        got = cleaning.preserving_core(frame(spark, rows), 7, 9, preserve=0.2)
    else:
        got = cleaning.adaptive_core(frame(spark, rows), 8, p=0.5)
    for _ in range(3):
        sizes = [Counter(r[i] for r in rest) for i in (0, 1)]
        least = [max(m, int(np.percentile(list(s.values()), 5))) if preserving else max(1, min(8, np.percentile(list(s.values()), 50)))
                 for s, m in zip(sizes, (7, 9))]
        rest = [r for r in rest if all(s[r[i]] >= n for i, (s, n) in enumerate(zip(sizes, least)))]
        if preserving and len(rest) < int(0.2 * len(rows)):
            break
    got = got.select("user_id", "item_id", "rating", "ts", "row_key").collect()
    assert sorted(map(tuple, got)) == sorted(rest) and 0 < len(rest) < len(rows)
    assert sum(wide) == 1


def test_draws_are_made_behind_the_shuffle(spark):
    """Positives go to their user once; without that each of their draws is shuffled. Results equal the heavy path's."""
    rows = training_sets.durable(training_sets.encoded(frame(spark, ROWS)))
    out = training_sets.negatives(rows, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user_idx") == 1
    plain = sorted(map(tuple, out.collect()))
    skew._known.clear()
    before, skew.limits.heavy_rows = skew.limits.heavy_rows, 4
    try:
        assert sorted(map(tuple, training_sets.negatives(rows, 4).collect())) == plain and len(plain) == 4 * len(ROWS)
    finally:
        skew.limits.heavy_rows = before
        skew._known.clear()
