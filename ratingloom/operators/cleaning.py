"""Row cleaning, minimum-count filters and exact-size samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import seeded_key
from ..functions.skew import first_in_order, heavy_keys, lookup_join, lowest_by_key
from ..session import durable


def drop_blank_ids(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Drop rows whose user or item id is null or the empty string."""
    return df.dropna(subset=[user, item]).filter(
        (F.col(user).cast("string") != "") & (F.col(item).cast("string") != ""))


def drop_unknown_ids(df: DataFrame, user: str = "user_id", item: str = "item_id",
                     marker: str = "unknown") -> DataFrame:
    """Drop rows whose user or item id is the loader's placeholder or null."""
    return df.filter((F.col(user).cast("string") != marker) & (F.col(item).cast("string") != marker))


def group_sizes(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def size_percentile(df: DataFrame, key: str, p: float) -> Column:
    """Scalar subquery: linear-interpolated percentile of the rows-per-key counts.

    Runs on the histogram of counts, so the aggregate state is one entry per distinct count.
    """
    hist = group_sizes(df, key).groupBy("n").agg(F.count(F.lit(1)).alias("freq"))
    return hist.select(F.percentile("n", F.lit(float(p)), F.col("freq"))).scalar()


def keep_large_groups(df: DataFrame, key: str, minimum: Column, counts_from: DataFrame | None = None) -> DataFrame:
    """Semi join on the keys having at least ``minimum`` rows in ``counts_from`` (default df)."""
    source = df if counts_from is None else counts_from
    keys = group_sizes(source, key).filter(F.col("n") >= minimum).select(key)
    return lookup_join(df, keys, key, "left_semi", heavy_keys(source, key))


def _trim_both(df: DataFrame, user: str, item: str, user_min: Column, item_min: Column) -> DataFrame:
    """One filter round: both thresholds and both counts come from the same snapshot."""
    kept = keep_large_groups(df, user, user_min, df)
    return keep_large_groups(kept, item, item_min, df)


def _kept_keys(pairs: DataFrame, keys: tuple[str, str], cut: Callable[[str, Column], Column], p: float) -> list[DataFrame]:
    """Of each key the values with at least ``cut`` (of the percentile ``p``) rows in ``pairs``; both counts see the same rows."""
    kept = []
    for k in keys:
        sizes = durable(group_sizes(pairs, k))
        hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("freq"))
        low = hist.select(F.percentile("n", F.lit(float(p)), F.col("freq"))).scalar()
        kept.append(durable(sizes.filter(F.col("n") >= cut(k, low)).select(k)))
    return kept


def _within(rows: DataFrame, keys: tuple[str, str], kept: list[DataFrame], heavy: dict[str, list]) -> DataFrame:
    """Rows whose both keys are kept."""
    for k, table in zip(keys, kept):
        rows = lookup_join(rows, table, k, "left_semi", heavy[k])
    return rows


def adaptive_core(df: DataFrame, min_interactions: int = 1, user: str = "user_id",
                  item: str = "item_id", rounds: int = 3, p: float = 0.10) -> DataFrame:
    """Blank-id cleaning, then up to ``rounds`` rounds of a count filter whose threshold is
    max(1, min(min_interactions, p10 of counts)) for users and for items.

    A round filters by ids alone, so rounds see only the ids of rows; whole rows meet the ids of the last round.
    """
    df = drop_blank_ids(df, user, item)
    if min_interactions <= 1:
        return df  # every present key has one row, so no round can drop anything
    low, df, keys = F.lit(float(min_interactions)), durable(df), (user, item)
    heavy = {k: heavy_keys(df, k) for k in keys}
    pairs, kept, size = df.select(*keys), None, None
    for _ in range(rounds):
        if kept:
            pairs = durable(_within(pairs, keys, kept, heavy))
        before, size = size, pairs.count()
        if size == before:
            break
        kept = _kept_keys(pairs, keys, lambda k, found: F.greatest(F.lit(1.0), F.least(low, found)), p)
    return _within(df, keys, kept, heavy) if kept else df


def preserving_core(df: DataFrame, min_user: int = 1, min_item: int = 1, max_iterations: int = 3,
                    preserve: float = 0.8, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Unknown-id cleaning, then count filter rounds with threshold max(min, int(p5 of counts)).

    Stops after a round that falls below int(rows * preserve) or drops nothing. Rounds see only the ids of rows.
    """
    df = durable(drop_unknown_ids(df, user, item))
    original = df.count()
    if original == 0:
        raise ValueError("no valid rows: every user or item id is unknown")
    target, size, keys, least = int(original * preserve), original, (user, item), {user: min_user, item: min_item}
    heavy = {k: heavy_keys(df, k) for k in keys}
    pairs, kept = df.select(*keys), None
    for nr in range(max_iterations):
        kept = _kept_keys(pairs, keys, lambda k, found: F.greatest(F.lit(least[k]), found.cast("bigint")), 0.05)
        if nr == max_iterations - 1:
            break  # nobody asks how many rows are left
        before, pairs = size, durable(_within(pairs, keys, kept, heavy))
        size = pairs.count()
        if size < target or size == before:
            break
    return _within(df, keys, kept, heavy) if kept else df


def minimum_counts(df: DataFrame, min_user: int = 10, min_item: int = 10,
                   user: str = "user_id", item: str = "item_id") -> DataFrame:
    """One pass: both counts are taken before either filter, so small groups can remain."""
    return _trim_both(df, user, item, F.lit(min_user), F.lit(min_item))


def minimum_user_rows(df: DataFrame, minimum: int = 5, user: str = "user_id") -> DataFrame:
    """Rows of users having at least ``minimum`` rows."""
    return keep_large_groups(df, user, F.lit(minimum))


def require_rows(df: DataFrame, minimum: int = 50) -> DataFrame:
    """Raise when fewer than ``minimum`` rows exist; reads at most that many."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"insufficient data: {found} rows, {minimum} needed")
    return df


def sample_rows(df: DataFrame, n: int, seed: int = 42, row_key: str = "row_key") -> DataFrame:
    """Exactly n rows (all rows when fewer), chosen by a seeded hash of the row key."""
    keyed = df.withColumn("_h", seeded_key(seed, row_key))
    return lowest_by_key(keyed, n, "_h", row_key).drop("_h")


def stratified_sample(df: DataFrame, n: int, seed: int = 42, active_rows: int = 5,
                      active_share: float = 0.7, user: str = "user_id",
                      row_key: str = "row_key") -> DataFrame:
    """About ``active_share`` of n rows from users with >= active_rows rows, the rest from others.

    Unchanged when the table has at most n rows.
    """
    total = df.count()
    if total <= n:
        return df
    heavy = heavy_keys(df, user)
    active = group_sizes(df, user).filter(F.col("n") >= active_rows).select(user)
    from_active = lookup_join(df, active, user, "left_semi", heavy)
    from_others = lookup_join(df, active, user, "left_anti", heavy)
    n_active = min(from_active.count(), int(n * active_share))
    return sample_rows(from_active, n_active, seed, row_key).unionByName(
        sample_rows(from_others, n - n_active, seed, row_key))


def first_users(df: DataFrame, n: int, order: list[str], user: str = "user_id") -> DataFrame:
    """All rows of the first n distinct users in row order."""
    chosen = df.groupBy(user).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first").limit(n).select(user)
    return lookup_join(df, chosen, user, "left_semi", heavy_keys(df, user))


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in row order."""
    return first_in_order(df, n, order)
