"""Neighbours and predictions for asked ids against brute force and the full similarity table."""

import math
import random
from collections import defaultdict

import pytest

from ratingloom.operators.asked_neighbors import asked_statistics, predict_asked
from ratingloom.operators.rating_models import knn_with_means
from ratingloom.operators.similarity import common_rater_similarity

SCHEMA = "user_id bigint, item_id bigint, rating double"


def cells(seed=3, users=25, items=14):
    """User 1 has rated every item and item 1 is rated by everyone: both sides have a hot key."""
    rng = random.Random(seed)
    found = {(1, i): float(rng.randint(1, 5)) for i in range(1, items + 1)}
    found |= {(u, 1): float(rng.randint(1, 5)) for u in range(1, users + 1)}
    for _ in range(110):
        found[rng.randint(1, users), rng.randint(1, items)] = float(rng.randint(1, 5))
    return [(u, i, r) for (u, i), r in found.items()]


def brute_statistics(rows, asked, user_based, support):
    vectors = defaultdict(dict)
    for u, i, r in rows:
        own, other = (u, i) if user_based else (i, u)
        vectors[own][other] = r
    out = {}
    for a in asked:
        for b in vectors:
            common = vectors[a].keys() & vectors[b].keys() if a in vectors else ()
            if a != b and len(common) >= support:
                xs = [(vectors[a][o], vectors[b][o]) for o in common]
                out[a, b] = (len(xs), sum(x * y for x, y in xs), sum(x * x for x, _ in xs), sum(y * y for _, y in xs),
                             sum((x - y) ** 2 for x, y in xs))
    return out


@pytest.mark.parametrize("user_based", [False, True])
@pytest.mark.parametrize("support", [1, 3])
def test_statistics_match_brute_force(spark, tiny_limits, user_based, support):
    rows, asked = cells(), [1, 2, 5, 999]
    own, other = ("user_id", "item_id") if user_based else ("item_id", "user_id")
    odd = [(None, 3, 2.0), (4, None, 2.0), (24, 13, None)]
    rows = [r for r in rows if r[:2] != (24, 13)]
    got = asked_statistics(spark.createDataFrame(rows + odd, SCHEMA),
                           spark.createDataFrame([(a,) for a in asked], f"{own} bigint"), own, other, support)
    assert got.columns == [own, "neighbor", "support", "ab", "aa", "bb", "dd"]
    found = {(r[0], r[1]): tuple(r)[2:] for r in got.collect() if r["support"] >= support}
    assert found == brute_statistics(rows, asked, user_based, support)


def test_a_hot_rater_alone_pairs_nothing(spark):
    # one user rates 300 items, every item has one more rater of its own: no pair has two common raters
    rows = [(0, i, 3.0) for i in range(300)] + [(1000 + i, i, 4.0) for i in range(300)]
    got = asked_statistics(spark.createDataFrame(rows, SCHEMA), spark.range(300).withColumnRenamed("id", "item_id"),
                           min_support=2)
    assert got.count() == 0


@pytest.mark.parametrize("measure,support,user_based,k", [
    ("cosine", 1, False, 40), ("cosine", 3, False, 2), ("msd", 2, True, 3)])
def test_predictions_match_the_full_table(spark, tiny_limits, measure, support, user_based, k):
    rows = cells()
    train = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame(
        [(u, i, f"{u}/{i}") for u in (1, 2, 3, 9, 77) for i in (1, 4, 6, 88)] + [(2, 4, "again")],
        "user_id bigint, item_id bigint, mean string")
    sim = common_rater_similarity(train, measure, user_based, support)
    full = knn_with_means(train, wanted.drop("mean"), sim, user_based, k)
    got = predict_asked(train, wanted, measure, support, user_based, k)
    assert got.columns == ["user_id", "item_id", "mean", "estimate"]
    a = sorted((r["user_id"], r["item_id"], r["estimate"]) for r in got.collect())
    b = sorted((r["user_id"], r["item_id"], r["estimate"]) for r in full.collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(a, b))


def test_odd_tables(spark):
    train = spark.createDataFrame(cells(), SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    wanted = spark.createDataFrame([(None, 1), (1, None), (None, None), (1, 2)], "user_id bigint, item_id bigint")
    assert predict_asked(train, none.drop("rating")).count() == 0
    assert [r["estimate"] for r in predict_asked(none, wanted, "msd", 2).collect()] == [None] * 4
    mean = sum(r for _, _, r in cells()) / len(cells())
    got = {(r["user_id"], r["item_id"]): r["estimate"] for r in predict_asked(train, wanted).collect()}
    assert len(got) == 4 and math.isclose(got[1, None], mean) and math.isclose(got[None, None], mean)
