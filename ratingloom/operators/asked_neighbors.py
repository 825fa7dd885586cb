"""Nearest neighbours and mean-centred predictions for asked ids only.

The full similarity table of all ids is never built: sums over common raters are accumulated for pairs
whose first id is asked and whose second one can vote for a wanted cell. A bound on the number of common
raters keeps the most frequent raters out of the pair join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..functions.skew import heavy_keys, lookup_join, top_per_group
from ..session import durable
from .pairs import matched_rows
from .similarity import similarity_from_common

SCALE = (1.0, 5.0)
_SUMS = ("support", "ab", "aa", "bb", "dd")


def _products(a, b) -> list:
    """The five sums' terms for one common rater with ratings a and b."""
    gap = a - b
    return [F.lit(1).cast("long").alias("support"), (a * b).alias("ab"), (a * a).alias("aa"), (b * b).alias("bb"),
            (gap * gap).alias("dd")]


def split_heads(ratings: DataFrame, own: str, other: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(own, heads) with the n most frequent ``other`` of each id as an array of (o, r), and all other rows.

    Ids are in one common order (frequency, then id). Two ids with more than n common others share at least
    one outside both arrays: their least frequent common one follows n others in either list.
    """
    frequency = ratings.groupBy(other).agg(F.count(F.lit(1)).alias("_f"))
    rows = durable(lookup_join(ratings, frequency, other, "inner", heavy_keys(ratings, other)))
    top = durable(top_per_group(rows, [own], [F.desc("_f"), F.desc(other)], n, "_r").select(own, other, "rating"))
    heads = top.groupBy(own).agg(F.collect_list(F.struct(F.col(other).alias("o"), F.col("rating").alias("r"))).alias("heads"))
    rest = rows.select(own, other, "rating").join(top.select(own, other), [own, other], "left_anti")
    return heads, rest


def asked_statistics(train: DataFrame, asked: DataFrame, own: str = "item_id", other: str = "user_id",
                     min_support: int = 1, voters: DataFrame | None = None) -> DataFrame:
    """(own, neighbor, support, ab, aa, bb, dd) of asked ids and the ids with min_support common raters.

    ``train`` (user_id, item_id, rating) has one row per pair, ``asked`` is a table of distinct ids, as is
    ``voters``: the ids that are looked at as neighbours, all without it.
    Pairs below min_support may be absent, others are complete: both directions, if both ids are asked.

    With min_support s > 1, the s - 1 most frequent raters of every id stay out of the pair join. A pair that
    is met without them gets their part by two look-ups on (id, rater): no more than 2 (s - 1) rows per pair,
    whatever the number of ids that share a rater. Null ids meet nothing.
    """
    ratings = train.select(own, other, F.col("rating").cast("double").alias("rating")).dropna(subset=[own, other, "rating"])
    n = min_support - 1
    heads, rest = (None, ratings) if n < 1 else split_heads(ratings, own, other, n)
    rest = rest if heads is None else durable(rest)
    left = lookup_join(rest, asked.select(own), own, "left_semi", heavy_keys(rest, own)).withColumnRenamed("rating", "a_r")
    right = rest if voters is None else lookup_join(rest, voters.select(own), own, "left_semi", heavy_keys(rest, own))
    right = right.select(F.col(own).alias("neighbor"), other, F.col("rating").alias("b_r"))
    met = matched_rows(left, right, other, own, "neighbor", heavy_keys(right, other)).filter(F.col(own) != F.col("neighbor"))
    sums = met.select(own, "neighbor", *_products(F.col("a_r"), F.col("b_r"))).groupBy(own, "neighbor").agg(
        *[F.sum(c).alias(c) for c in _SUMS])
    if heads is None:
        return sums
    sums = durable(sums)
    theirs = heads.select(F.col(own).alias("neighbor"), F.col("heads").alias("b_heads"))
    pairs = sums.select(own, "neighbor")
    pairs = lookup_join(pairs, heads.withColumnRenamed("heads", "a_heads"), own, "left", heavy_keys(pairs, own))
    pairs = durable(lookup_join(pairs, theirs, "neighbor", "left", heavy_keys(sums, "neighbor")))
    # raters in both arrays: within the row
    both = pairs.select(own, "neighbor", F.explode("a_heads").alias("a"), "b_heads").select(
        own, "neighbor", "a", F.explode("b_heads").alias("b")).filter("a.o = b.o").select(
        own, "neighbor", *_products(F.col("a.r"), F.col("b.r")))
    # raters in one array only: looked up among the other id's remaining rows
    a_only = pairs.select(own, "neighbor", F.explode("a_heads").alias("a")).select(
        own, "neighbor", F.col("a.o").alias(other), F.col("a.r").alias("a_r")).join(right, ["neighbor", other]).select(
        own, "neighbor", *_products(F.col("a_r"), F.col("b_r")))
    b_only = pairs.select(own, "neighbor", F.explode("b_heads").alias("b")).select(
        own, "neighbor", F.col("b.o").alias(other), F.col("b.r").alias("b_r")).join(
        rest.withColumnRenamed("rating", "a_r"), [own, other]).select(
        own, "neighbor", *_products(F.col("a_r"), F.col("b_r")))
    every = sums.unionByName(both).unionByName(a_only).unionByName(b_only)
    return every.groupBy(own, "neighbor").agg(*[F.sum(c).alias(c) for c in _SUMS])


def predict_asked(train: DataFrame, wanted: DataFrame, measure: str = "cosine", min_support: int = 1,
                  user_based: bool = False, k: int = 40, scale: tuple[float, float] = SCALE) -> DataFrame:
    """``wanted`` rows (user_id, item_id, ..) with estimate, as ``knn_with_means``, for asked ids only.

    estimate = mean + sum(sim * (r - neighbour's mean)) / sum(sim) over the k most similar neighbours with
    positive similarity that share the other id (ties to the smaller id); the mean without any; the overall
    mean for a new or null id, null without ratings at all. Wanted rows may repeat, each is returned; a column
    "estimate" of theirs is replaced. ``train`` has one row per (user, item).
    """
    own, other = ("user_id", "item_id") if user_based else ("item_id", "user_id")
    asked = durable(wanted.select("user_id", "item_id").dropna().distinct())
    means = durable(train.groupBy(own).agg(F.avg("rating").alias("_mean")))
    overall = train.select(F.avg("rating")).scalar()
    # only rows of an other id that is asked too can vote
    votes = durable(lookup_join(train.select(own, other, "rating"), asked.select(other).distinct(), other, "left_semi",
                                heavy_keys(train, other)))
    stats = asked_statistics(train, asked.select(own).distinct(), own, other, min_support, votes.select(own).distinct())
    sim = similarity_from_common(stats.withColumnsRenamed({own: "a", "neighbor": "b"}), measure, min_support)
    # a written table: the adaptive rule can then split the offers of a pair that many ids share
    sim = durable(sim.filter("sim > 0").select(F.col("a").alias(own), F.col("b").alias("neighbor"), "sim"))
    known = lookup_join(votes, means, own, "inner", heavy_keys(train, own)).select(
        other, F.col(own).alias("neighbor"), (F.col("rating") - F.col("_mean")).alias("gap"))
    offers = matched_rows(asked, known, other, own, "neighbor", heavy_keys(train, other))
    best = top_per_group(offers.join(sim, [own, "neighbor"]), ["user_id", "item_id"],
                         [F.desc("sim"), F.asc("neighbor")], k, "_r")
    shift = best.groupBy("user_id", "item_id").agg(
        (F.sum(F.col("sim") * F.col("gap")) / F.sum("sim")).alias("_shift"))
    out = lookup_join(wanted, means, own, "left", heavy_keys(wanted, own)).join(shift, ["user_id", "item_id"], "left")
    value = F.coalesce(F.col("_mean") + F.coalesce("_shift", F.lit(0.0)), overall)
    kept = [c for c in wanted.columns if c != "estimate"]
    return out.withColumn("estimate", F.when(value.isNotNull(), clip(value, *scale))).select(*kept, "estimate")
