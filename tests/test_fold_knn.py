"""Neighbour predictions of all folds in one pass against one fold after the other."""

import math

import pytest
from data import frame
from pyspark.sql import functions as F

from ratingloom.operators.rating_models import cross_predictions, fold_knn, knn_with_means
from ratingloom.operators.similarity import common_rater_similarity, fold_rater_statistics, similarity_from_common
from ratingloom.operators.splits import hashed_folds



@pytest.mark.parametrize("measure,support,user_based,k", [("cosine", 1, False, 2), ("msd", 2, True, 40)])
def test_one_pass_equals_fold_by_fold(spark, tiny_limits, measure, support, user_based, k):
    cells = frame(spark).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    # an id with one cell only has no mean outside of that cell's fold
    cells = cells.unionByName(spark.createDataFrame([(77, 1, 2.0), (2, 88, 5.0)], cells.schema))
    folds = hashed_folds(cells.withColumn("row_key", F.concat_ws("|", "user_id", "item_id"))).drop("row_key").cache()

    def predict(train, test):
        return knn_with_means(train, test, common_rater_similarity(train, measure, user_based, support), user_based, k)

    def rows(df):
        return sorted((r["user_id"], r["item_id"], r["rating"], r["estimate"]) for r in df.collect())

    want = rows(cross_predictions(folds, predict))
    sim = similarity_from_common(fold_rater_statistics(folds, user_based), measure, support, ("fold",))
    got = rows(fold_knn(folds, sim, user_based, k))
    assert len(got) == cells.count()
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], abs_tol=1e-9) for a, b in zip(got, want))
    assert fold_knn(folds.limit(0), sim, user_based, k).count() == 0
