"""Id encoding, interaction weights, user-item cells and user profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import whole_days
from ..functions.skew import dense_index, heavy_keys, lookup_join, number_in_group


def encode_sorted(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """(key, idx): 0-based code in label order."""
    return dense_index(df.select(key).distinct(), [key], name)


def encode_first_seen(df: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    """(key, idx): 0-based code in order of first appearance."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return dense_index(first, ["_first"], name).drop("_first")


def decay_factor(df: DataFrame, decay: float, ts: str = "ts") -> Column:
    """decay ** (whole days before the newest row / 365); null for a null time."""
    newest = df.select(F.max(ts)).scalar()
    return F.pow(F.lit(float(decay)), whole_days(newest - F.col(ts)) / F.lit(365.0))


def time_decay(df: DataFrame, decay: float = 0.95, ts: str = "ts", name: str = "decay") -> DataFrame:
    return df.withColumn(name, decay_factor(df, decay, ts))


def interaction_weight(df: DataFrame, implicit: bool = True, decay: float | None = 0.95,
                       rating: str | None = "rating", ts: str = "ts", name: str = "w") -> DataFrame:
    """Matrix weight: 1 x decay (1 where the time is unusable) if implicit, else the rating."""
    if not implicit:
        return df.withColumn(name, F.col(rating) if rating else F.lit(1.0))
    if decay is None:
        return df.withColumn(name, F.lit(1.0))
    return df.withColumn(name, F.coalesce(decay_factor(df, decay, ts), F.lit(1.0)))


def user_item_cells(weighted: DataFrame, user: str = "user_id", item: str = "item_id",
                    w: str | list[str] = "w") -> DataFrame:
    """(user, item, w, n): duplicate cells summed, n = rows in the cell."""
    cols = [w] if isinstance(w, str) else w
    return weighted.groupBy(user, item).agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n"))


def matrix_shape(cells: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """One row: n_users, n_items, nnz, density."""
    return cells.agg(
        F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"),
        F.count(F.lit(1)).alias("nnz"),
    ).withColumn("density", F.col("nnz") / (F.col("n_users") * F.col("n_items")))


def item_idf(cells: DataFrame, user: str = "user_id", item: str = "item_id", w: str = "w") -> DataFrame:
    """(item, n_holders, idf): ln(n_users / (1 + users with a positive cell)), 0 with none."""
    n_users = cells.select(F.count_distinct(user)).scalar()
    held = cells.groupBy(item).agg(F.count_if(F.col(w) > 0).alias("n_holders"))
    idf = F.when(F.col("n_holders") > 0, F.log(n_users / (1 + F.col("n_holders")))).otherwise(F.lit(0.0))
    return held.withColumn("idf", idf)


def user_profiles(df: DataFrame, user: str = "user_id", item: str = "item_id",
                  rating: str | None = "rating", ts: str | None = "ts") -> DataFrame:
    """One row per user: distinct items, rows, first and last time, mean rating.

    The ordered item list of a user stays a row set (user_history): one user's list may be
    as long as a third of the table and must not become a single cell.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(item).alias("n_items")]
    if ts:
        aggs += [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    if rating:
        aggs.append(F.avg(rating).alias("avg_rating"))
    return df.groupBy(user).agg(*aggs)


def user_history(df: DataFrame, order: tuple[str, ...] = ("ts", "row_key"), user: str = "user_id",
                 item: str = "item_id") -> DataFrame:
    """(user, pos, item, ts, is_first): the rows of a user in time order, and whether the item is new to the user."""
    numbered = number_in_group(df, user, list(order), "pos", None)
    first = numbered.groupBy(user, item).agg(F.min("pos").alias("_first"))
    return numbered.join(first, [user, item]).select(user, "pos", item, "ts", (F.col("pos") == F.col("_first")).alias("is_first"))


def helpfulness(helpful: Column) -> Column:
    """Share of helpful votes, 0.5 without votes."""
    return F.when(F.get(helpful, F.lit(1)) > 0,
                  F.get(helpful, F.lit(0)) / F.get(helpful, F.lit(1))).otherwise(F.lit(0.5))


def with_expertise(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Add helpfulness per row and user_expertise, its mean over all rows of the user."""
    rows = df.withColumn("helpfulness", helpfulness(F.col("helpful")))
    mean = rows.groupBy(user).agg(F.avg("helpfulness").alias("user_expertise"))
    return lookup_join(rows, mean, user, "left", heavy_keys(df, user))


def signal_weight(df: DataFrame, ts: str = "ts") -> Column:
    """rating/5 x recency x helpfulness x verified x expertise weight of a review."""
    oldest = df.select(F.min(ts)).scalar()
    newest = df.select(F.max(ts)).scalar()
    recency = F.lit(1.0) + F.lit(0.5) * (F.col(ts) - oldest) / (newest - oldest + 1)
    return ((F.col("rating") / F.lit(5.0)) * F.sqrt(recency)
            * (F.lit(1.0) + F.lit(0.3) * F.col("helpfulness"))
            * (F.lit(1.0) + F.lit(0.2) * F.col("verified").cast("double"))
            * (F.lit(1.0) + F.lit(0.2) * F.col("user_expertise")))


def activity_normalised(weighted: DataFrame, user: str = "user_id", item: str = "item_id",
                        w: str = "w", heavy: list | None = None) -> DataFrame:
    """(user, item, w): cells divided by the user's total; a user with total 0 is unchanged."""
    cells = weighted.groupBy(user, item).agg(F.sum(w).alias("w"))
    total = weighted.groupBy(user).agg(F.sum(w).alias("_total"))
    joined = lookup_join(cells, total, user, "left", heavy)
    return joined.select(user, item, (F.col("w") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))).alias("w"))
