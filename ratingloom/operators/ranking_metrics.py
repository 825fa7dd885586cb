"""Ranking quality of recommendation lists: (user_id, item_id, rank) against test rows.

A user's list has at most k rows, so the per-user windows here are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import share
from ..functions.skew import lookup_join


def flag_hits(recs: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """First k recommendations of users with test rows, with hit and the user's distinct test items."""
    relevant = test.select("user_id", "item_id").distinct()
    sizes = relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_test"))
    listed = recs.filter(F.col("rank") <= k).select("user_id", "item_id", "rank").join(sizes, "user_id")
    return listed.join(relevant.withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(0)))


def _ideal_gain(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0),
                       lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0)))


def user_metrics(flagged: DataFrame, k: int = 10, per: str = "listed", ideal: str = "relevant") -> DataFrame:
    """One row per user: hits, precision, recall, f1, mrr, ndcg, map.

    per = "listed" divides precision by the list length, "k" by k; ideal = "relevant" takes
    min(test items, k) ideal positions, "hits" min(hits, k).
    """
    running = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = flagged.withColumn("_at", F.sum("hit").over(running) / F.col("rank"))
    users = marked.groupBy("user_id").agg(
        F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("listed"), F.max("n_test").alias("n_test"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + F.lit(1.0))).alias("_dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("_first"),
        F.sum(F.col("hit") * F.col("_at")).alias("_ap"))
    best = F.least(F.col("n_test") if ideal == "relevant" else F.col("hits"), F.lit(k))
    precision = F.col("hits") / (F.col("listed") if per == "listed" else F.lit(k))
    recall = F.col("hits") / F.col("n_test")
    some = F.col("hits") > 0
    return users.select(
        "user_id", "hits", "listed", "n_test", precision.alias("precision"), recall.alias("recall"),
        F.when(some, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.when(some, F.lit(1.0) / F.col("_first")).otherwise(0.0).alias("mrr"),
        F.when(some, F.col("_dcg") / _ideal_gain(best)).otherwise(0.0).alias("ndcg"),
        F.when(some, F.col("_ap") / F.col("hits")).otherwise(0.0).alias("map"))


def _mean(col: str, over: str) -> Column:
    value = F.when(F.col("hits") > 0, F.col(col)) if over == "hit_users" else F.col(col)
    return F.coalesce(F.avg(value), F.lit(0.0))


def _rows(wide: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return wide.select(pairs.alias("_m")).select("_m.metric", "_m.value")


def coverage(recs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """One row: distinct recommended items / distinct items of ``items``."""
    n_items = items.select(F.count_distinct("item_id")).scalar()
    return recs.filter(F.col("rank") <= k).agg((F.count_distinct("item_id") / n_items).alias("coverage"))


def evaluate_lists(recs: DataFrame, test: DataFrame, items: DataFrame, k: int = 10,
                   over: str = "hit_users") -> DataFrame:
    """(metric, value) of the item-based evaluation.

    Means are taken over users with a hit (over = "hit_users", the published rule) or over
    all users ("all_users"); NDCG's ideal is min(test items, k).
    """
    flagged = flag_hits(recs, test, k)
    users = user_metrics(flagged, k)
    wide = users.agg(
        *[_mean(c, over).alias(n) for c, n in (
            ("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"), ("ndcg", "NDCG"), ("map", "MAP"), ("mrr", "MRR"))],
        share(F.count_if(F.col("hits") > 0), F.count(F.lit(1))).alias("HitRate"),
        F.count(F.lit(1)).alias("Users_Evaluated"))
    wide = wide.withColumn("Coverage", coverage(flagged, items, k).scalar())
    return _rows(wide, ["Precision", "Recall", "F1", "NDCG", "MAP", "MRR", "HitRate", "Coverage", "Users_Evaluated"])


def evaluate_blend(recs: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """(metric, value) of the ensemble: hit-user means of precision, recall, F1; hit rate; users."""
    users = user_metrics(flag_hits(recs, test, k), k)
    wide = users.agg(_mean("precision", "hit_users").alias("Precision"), _mean("recall", "hit_users").alias("Recall"),
                     _mean("f1", "hit_users").alias("F1"),
                     share(F.count_if(F.col("hits") > 0), F.count(F.lit(1))).alias("HitRate"),
                     F.count(F.lit(1)).alias("Users_Evaluated"))
    return _rows(wide, wide.columns)


def evaluate_hybrid(recs: DataFrame, test: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """(metric, value) of the hybrid evaluation: means over all users, precision = hits / k,
    NDCG's ideal is min(hits, k), F1 is built from the mean precision and recall."""
    flagged = flag_hits(recs, test, k)
    users = user_metrics(flagged, k, per="k", ideal="hits")
    wide = users.agg(
        *[_mean(c, "all_users").alias(n) for c, n in (
            ("precision", "Precision"), ("recall", "Recall"), ("ndcg", "NDCG"), ("map", "MAP"), ("mrr", "MRR"))],
        share(F.count_if(F.col("hits") > 0), F.count(F.lit(1))).alias("HitRate"))
    p, r = F.col("Precision"), F.col("Recall")
    wide = wide.withColumn("F1", 2 * p * r / (p + r + F.lit(1e-8)))
    wide = wide.withColumn("Coverage", coverage(flagged, train, k).scalar())
    return _rows(wide, ["Precision", "Recall", "NDCG", "MAP", "MRR", "HitRate", "F1", "Coverage"])


def _small_groups(train: DataFrame, key: str, at_most: int) -> DataFrame:
    return train.groupBy(key).agg(F.count(F.lit(1)).alias("n_train")).filter(F.col("n_train") <= at_most)


def evaluate_cold_users(recs: DataFrame, test: DataFrame, train: DataFrame, k: int = 10, at_most: int = 5) -> DataFrame:
    """One row for users with at most ``at_most`` train rows: count, precision, hit rate and
    time_to_first_good, the mean history length of those with a hit."""
    users = user_metrics(flag_hits(recs, test, k), k, per="k", ideal="hits")
    cold = users.join(_small_groups(train, "user_id", at_most), "user_id")
    n = F.count(F.lit(1))
    return cold.agg(
        n.alias("cold_users"),
        share(F.sum("precision"), n).alias("cold_user_precision"),
        share(F.count_if(F.col("hits") > 0), n).alias("cold_user_hit_rate"),
        F.coalesce(F.avg(F.when(F.col("hits") > 0, F.col("n_train"))), F.lit(0.0)).alias("time_to_first_good"))


def evaluate_cold_items(recs: DataFrame, test: DataFrame, train: DataFrame, k: int = 10, at_most: int = 5) -> DataFrame:
    """One row: users hit by a cold item, and their mean share of cold hits in k."""
    hits = flag_hits(recs, test, k).filter("hit = 1")
    cold = lookup_join(hits, _small_groups(train, "item_id", at_most).select("item_id"), "item_id", "left_semi")
    users = cold.groupBy("user_id").agg((F.count(F.lit(1)) / F.lit(k)).alias("p"))
    return users.agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("cold_item_precision"))


def evaluate_novelty(recs: DataFrame, test: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean over users of the list's mean -log2(item rows / all rows); unseen items count 1."""
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    total = train.select(F.count(F.lit(1))).scalar()
    rows = lookup_join(flag_hits(recs, test, k), counts, "item_id", "left")
    value = -F.log2(F.coalesce("_n", F.lit(1)) / total)
    return rows.groupBy("user_id").agg(F.avg(value).alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("novelty"))


def evaluate_diversity(recs: DataFrame, test: DataFrame, features: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean over users of 1 - mean pairwise cosine in the list; lists with fewer than
    two items with features add 0. ``features`` is long (item_id, feature, value).

    Distinct item pairs of the lists are scored once; a list gives at most k * (k - 1) / 2.
    """
    listed = flag_hits(recs, test, k).select("user_id", "item_id", "rank")
    known = listed.join(features.select("item_id").distinct(), "item_id", "left_semi")
    left = known.select("user_id", F.col("item_id").alias("a"))
    right = known.select("user_id", F.col("item_id").alias("b"))
    pairs = left.join(right, "user_id").filter("a < b")
    cosines = pair_cosines(pairs.select("a", "b").distinct(), features)
    per_user = pairs.join(cosines, ["a", "b"], "left").groupBy("user_id").agg(
        (F.lit(1.0) - F.avg(F.coalesce("cosine", F.lit(0.0)))).alias("d"))
    n_users = listed.select(F.count_distinct("user_id")).scalar()
    return per_user.agg((F.coalesce(F.sum("d"), F.lit(0.0)) / n_users).alias("diversity"))


def pair_cosines(pairs: DataFrame, features: DataFrame, item: str = "item_id") -> DataFrame:
    """(a, b, cosine) of given item pairs over long features; no common feature = no row."""
    norms = features.groupBy(item).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    unit = lookup_join(features, norms, item, "inner").filter("norm > 0").select(
        item, "feature", (F.col("value") / F.col("norm")).alias("u"))
    one = unit.select(F.col(item).alias("a"), "feature", F.col("u").alias("ua"))
    two = unit.select(F.col(item).alias("b"), "feature", F.col("u").alias("ub"))
    return (pairs.join(one, "a").join(two, ["b", "feature"]).groupBy("a", "b")
            .agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine")))


def summary(metrics: DataFrame, target: float = 0.05) -> DataFrame:
    """Mean of each metric over k; for F1 also whether it reaches the target and the factor missing."""
    mean = metrics.filter(F.col("metric").isin("Precision", "Recall", "F1", "NDCG", "HitRate")).groupBy("metric").agg(
        F.avg("value").alias("mean_value"))
    f1 = F.col("metric") == "F1"
    return mean.withColumn("reached", f1 & (F.col("mean_value") >= target)).withColumn(
        "factor_needed", F.when(f1 & (F.col("mean_value") > 0) & (F.col("mean_value") < target), target / F.col("mean_value")))


def split_stats(train: DataFrame, test: DataFrame, at_most: int = 5) -> DataFrame:
    """One row: sizes of both parts, rows per user and item, cold shares of train."""
    def cold(key: str) -> Column:
        sizes = train.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return sizes.select(share(F.count_if(F.col("n") <= at_most), F.count(F.lit(1)))).scalar()

    n_test = test.select(F.count(F.lit(1))).scalar()
    users = test.select(F.count_distinct("user_id")).scalar()
    return train.agg(
        F.count(F.lit(1)).alias("train_rows"), F.count_distinct("user_id").alias("train_users"),
        F.count_distinct("item_id").alias("train_items"),
    ).select(
        "train_rows", "train_users", "train_items", n_test.alias("test_rows"), users.alias("test_users"),
        (n_test / (F.col("train_rows") + n_test)).alias("test_share"),
        (F.col("train_rows") / F.col("train_users")).alias("rows_per_user"),
        (F.col("train_rows") / F.col("train_items")).alias("rows_per_item"),
        cold("user_id").alias("cold_user_share"), cold("item_id").alias("cold_item_share"))


def rating_error(predictions: DataFrame, truth: str = "rating", estimate: str = "estimate",
                 by: list[str] | None = None) -> DataFrame:
    """rmse, mae, n: one row, or one per value of ``by``."""
    e = F.col(estimate) - F.col(truth)
    return predictions.groupBy(*(by or [])).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"))
