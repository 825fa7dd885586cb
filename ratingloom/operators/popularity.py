"""Item popularity, popular lists and cold-start picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import score
from .weights import decay_factor


def item_popularity(df: DataFrame, decay: float | None = 0.95, item: str = "item_id", ts: str = "ts") -> DataFrame:
    """(item, pop): summed time weight (or row count) / all rows; an unusable time adds 0."""
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.withColumn("_d", decay_factor(df, decay, ts) if decay is not None else F.lit(1.0))
    return rows.groupBy(item).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_s")).select(
        item, score(F.col("_s") / total).alias("pop"))


def popular_items(popularity: DataFrame, cap: int = 100, part: float = 0.3, item: str = "item_id") -> DataFrame:
    """(item, pop, rank): the first min(cap, int(part * items)) items by popularity."""
    bound = F.least(F.lit(cap), F.floor(popularity.select(F.count(F.lit(1))).scalar() * F.lit(float(part))))
    top = popularity.orderBy(F.desc("pop"), item).limit(cap)
    rank = F.row_number().over(Window.orderBy(F.desc("pop"), item))  # over at most cap rows
    return top.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= bound)


def popular_for(users: DataFrame, seen: DataFrame, popular: DataFrame, top_n: int = 10,
                user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, item, score, rank): the first top_n of the 2 * top_n most popular items, unseen ones only.

    The list is at most 2 * top_n entries, attached as an array.
    """
    entries = (popular.filter(F.col("rank") <= 2 * top_n)
               .agg(F.array_sort(F.collect_list(F.struct("rank", item, "pop")))).scalar())
    offered = users.select(user, F.explode(entries).alias("_e")).select(
        user, F.col(f"_e.{item}").alias(item), F.col("_e.pop").alias("score"), F.col("_e.rank").alias("_r"))
    fresh = offered.join(seen.select(user, item), [user, item], "left_anti")
    order = Window.partitionBy(user).orderBy("_r")
    return (fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
            .select(user, item, "score", F.col("rank").cast("bigint").alias("rank")))


def popularity_percentile(df: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, n, pct): average rank of the item's row count / number of items.

    Ranks come from the histogram of counts (at most sqrt(2 * rows) distinct values).
    """
    sizes = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("c").over(Window.partitionBy())
    ranked = hist.select("n", ((F.coalesce(F.sum("c").over(before), F.lit(0)) + (F.col("c") + 1) / 2.0) / total).alias("pct"))
    return sizes.join(ranked, "n").select(item, "n", "pct")


def best_rated(df: DataFrame, k: int = 10, min_rows: int = 10, item: str = "item_id", rating: str = "rating") -> DataFrame:
    """Picks for unknown users: the 2k best mean ratings, then those with min_rows rows, first k."""
    aggs = df.groupBy(item).agg(score(F.avg(rating)).alias("rating_mean"), F.count(rating).alias("rating_count"))
    order = [F.desc("rating_mean"), F.asc(item)]
    return aggs.orderBy(*order).limit(2 * k).filter(F.col("rating_count") >= min_rows).orderBy(*order).limit(k)
