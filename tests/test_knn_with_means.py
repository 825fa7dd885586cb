"""Predictions whose similarities are built where they are used equal those from the similarity table."""

import random

import pytest

from ratingloom.operators.rating_models import knn_with_means
from ratingloom.operators.similarity import common_rater_similarity


@pytest.mark.parametrize("user_based, measure, support", [(False, "cosine", 1), (True, "msd", 2)])
def test_similarities_on_the_way_equal_the_table(spark, monkeypatch, user_based, measure, support):
    from ratingloom.functions import skew
    monkeypatch.setattr(skew.limits, "segment_rows", 3)
    rng = random.Random(8)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(20) for i in range(12) if rng.random() < 0.5]
    schema = "user_id bigint, item_id bigint, rating double"
    train = spark.createDataFrame([*rows[::2], (50, 60, None), (None, 3, 2.0), (4, None, 1.0)], schema)
    wanted = spark.createDataFrame([*rows[1::2], (99, 3, 1.0), (3, 99, 1.0)], schema)
    sim = common_rater_similarity(train, measure, user_based, support)
    want = knn_with_means(train, wanted, sim, user_based, 4)
    got = knn_with_means(train, wanted, user_based=user_based, k=4, measure=measure, min_support=support)
    key = lambda df: sorted((r["user_id"], r["item_id"], round(r["estimate"], 9)) for r in df.collect())
    assert key(got) == key(want)
    assert len({round(r["estimate"], 6) for r in got.collect()}) > 20
