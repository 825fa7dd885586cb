"""Training samples: positives, negatives outside the history, user and mini batches, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import key_to_long, seeded_key
from ..functions.skew import dense_index, heavy_keys, lookup_join, number_in_group, running_sum, top_per_group
from ..session import durable
from .weights import encode_first_seen

ORDER = ("ts", "row_key")


def encoded(df: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows with user_idx and item_idx, both in order of first appearance. Five passes read the rows, so they are written once."""
    df = durable(df)
    users = encode_first_seen(df, "user_id", list(order), "user_idx")
    items = encode_first_seen(df, "item_id", list(order), "item_idx")
    rows = lookup_join(df, users, "user_id", "inner", heavy_keys(df, "user_id"))
    return lookup_join(rows, items, "item_id", "inner", heavy_keys(df, "item_id"))


def positives(rows: DataFrame, row_key: str = "row_key") -> DataFrame:
    """(row_key, draw = 0, user_idx, item_idx, rating, label = 1, ts) of encoded rows; defaults 1.0 and 0."""
    return rows.select(
        row_key, F.lit(0).alias("draw"), "user_idx", "item_idx",
        F.coalesce(F.col("rating"), F.lit(1.0)).cast("float").alias("rating"),
        F.lit(1.0).cast("float").alias("label"), F.coalesce(F.col("ts"), F.lit(0)).alias("ts"))


def negatives(rows: DataFrame, ratio: int = 4, seed: int = 42, row_key: str = "row_key") -> DataFrame:
    """``ratio`` unseen items per positive, uniform and with replacement across draws.

    A draw is a rank r among the n_items - h items the user has not seen. The r-th unseen item
    is r plus the number of seen items whose idx minus their own rank is <= r, so one ordered
    pass per user over (seen gaps + draws) resolves every draw: no rejection, no item list per
    user, no cross join. A user who has seen everything gets any item.
    """
    n_items = rows.select(F.count_distinct("item_idx")).scalar()
    heavy = heavy_keys(rows, "user_idx")
    draws = F.sequence(F.lit(1), F.lit(ratio))
    if heavy:
        seen = rows.select("user_idx", "item_idx").distinct()
        gaps = number_in_group(seen, "user_idx", ["item_idx"], "_rank", None, heavy).select(
            "user_idx", (F.col("item_idx") - F.col("_rank") + 1).alias("value"), F.lit("").alias(row_key),
            F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("bigint").alias("_h"), F.lit(0).alias("draw"))
        held = seen.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_h"))
        wanted = lookup_join(rows.select("user_idx", F.lit(None).cast("bigint").alias("value"), row_key, "ts"), held, "user_idx", "inner", heavy)
        both = gaps.unionByName(wanted.withColumn("draw", F.explode(draws)))
    else:
        # a positive is shuffled once, to its user; a gap (draw 0) and the draws are made of it there
        of_user = Window.partitionBy("user_idx")
        ranked = rows.select("user_idx", "item_idx", row_key, "ts").select(
            "*", F.dense_rank().over(of_user.orderBy("item_idx")).cast("bigint").alias("_rank"),
            F.lag("item_idx").over(of_user.orderBy("item_idx")).alias("_before")).withColumn("_h", F.max("_rank").over(of_user))
        again = F.coalesce(F.col("_before") == F.col("item_idx"), F.lit(False))
        both = ranked.select("user_idx", (F.col("item_idx") - F.col("_rank") + 1).alias("value"), row_key, "ts", "_h",
                             F.explode(F.when(again, draws).otherwise(F.sequence(F.lit(0), F.lit(ratio)))).alias("draw"))
    is_gap = F.col("draw") == 0
    key = key_to_long(seeded_key(seed, row_key, "draw"))
    free = n_items - F.col("_h")
    mixed = both.select(
        "user_idx", F.when(is_gap, F.col("value")).when(free > 0, F.pmod(key, free)).otherwise(F.pmod(key, n_items)).alias("value"),
        F.when(is_gap, F.lit(1)).when(free > 0, F.lit(0)).otherwise(F.lit(-1)).cast("bigint").alias("is_seen"), "draw", row_key,
        F.coalesce("ts", F.lit(0)).alias("ts"))
    # seen gaps sort before draws of the same value; is_seen = -1 marks users without unseen items
    mixed = mixed.withColumn("_step", F.greatest("is_seen", F.lit(0))).withColumn("_kind", -F.col("_step"))
    placed = running_sum(mixed, "user_idx", ["value", "_kind", row_key, "draw"], "_step", "_shift", heavy)
    return placed.filter("is_seen <= 0").select(
        row_key, "draw", "user_idx",
        (F.col("value") + F.when(F.col("is_seen") == 0, F.col("_shift")).otherwise(F.lit(0))).alias("item_idx"),
        F.lit(0.0).cast("float").alias("rating"), F.lit(0.0).cast("float").alias("label"), "ts")


def training_set(df: DataFrame, ratio: int = 4, seed: int = 42) -> DataFrame:
    """Positives followed by negatives; rows * (1 + ratio) samples."""
    rows = durable(encoded(df))
    return positives(rows).unionByName(negatives(rows, ratio, seed))


def items_of_users(df: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Distinct (user_id, item_id), optionally only of the given users."""
    rows = df if users is None else df.join(users.select("user_id"), "user_id", "left_semi")
    return rows.select("user_id", "item_id").distinct()


def users_of_items(df: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Distinct (item_id, user_id), optionally only of the given items."""
    rows = df if items is None else df.join(items.select("item_id"), "item_id", "left_semi")
    return rows.select("item_id", "user_id").distinct()


def user_batches(df: DataFrame, batch_size: int = 32, items_per_user: int = 4, seed: int = 42) -> DataFrame:
    """(batch_id, user_id, row_key): items_per_user random rows of each user with enough rows,
    max(1, batch_size // items_per_user) users per batch in random order, last partial batch dropped."""
    per_batch = max(1, batch_size // items_per_user)
    users = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= items_per_user)
    shuffled = dense_index(users.select("user_id", seeded_key(seed, "user_id").alias("_h")), ["_h", "user_id"], "_i")
    total = users.select(F.count(F.lit(1))).scalar()
    batches = shuffled.select("user_id", F.floor(F.col("_i") / per_batch).alias("batch_id")).filter(
        F.col("batch_id") < F.floor(total / per_batch))
    keyed = df.select("user_id", "row_key").withColumn("_h", seeded_key(seed, "row_key"))
    picked = top_per_group(keyed, "user_id", [F.asc("_h"), F.asc("row_key")], items_per_user, "_r")
    return picked.join(batches, "user_id").select("batch_id", "user_id", "row_key")


def mini_batches(df: DataFrame, batch_size: int = 32, shuffle: bool = True, seed: int = 42,
                 order: tuple[str, ...] = ORDER, row_key: str = "row_key") -> DataFrame:
    """Add batch_id: position // batch_size in seeded random or row order; the last may be partial."""
    if not shuffle:
        return dense_index(df, list(order), "_i").withColumn("batch_id", F.floor(F.col("_i") / batch_size)).drop("_i")
    keyed = df.withColumn("_h", seeded_key(seed, row_key))
    return (dense_index(keyed, ["_h", row_key], "_i")
            .withColumn("batch_id", F.floor(F.col("_i") / batch_size)).drop("_i", "_h"))


def write_batches(batched: DataFrame, path: str, batches_per_folder: int = 1000) -> None:
    """Write batches clustered by id; a folder holds a range of batch ids."""
    (batched.withColumn("part", F.floor(F.col("batch_id") / batches_per_folder))
     .repartition("part").sortWithinPartitions("batch_id").write.mode("overwrite").partitionBy("part").parquet(path))


SAMPLE_TYPES = {"user_idx": "bigint", "item_idx": "bigint", "rating": "float", "label": "float", "ts": "bigint"}


def validate_samples(samples: DataFrame) -> DataFrame:
    """One row of checks on a training set; raises when a column is missing or has another type."""
    found = dict(samples.dtypes)
    wrong = {c: t for c, t in SAMPLE_TYPES.items() if found.get(c) != t}
    if wrong:
        raise ValueError(f"expected columns {wrong}, found {({c: found.get(c) for c in wrong})}")
    history = samples.filter("label = 1").select("user_idx", "item_idx").distinct()
    clash = samples.filter("label = 0").join(history, ["user_idx", "item_idx"], "left_semi").select(F.count(F.lit(1))).scalar()
    any_null = F.lit(False)
    for c in SAMPLE_TYPES:
        any_null = any_null | F.col(c).isNull()
    return samples.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"), F.count_if(any_null).alias("n_null"),
        F.min("user_idx").alias("min_user"), F.max("user_idx").alias("max_user"),
        F.min("item_idx").alias("min_item"), F.max("item_idx").alias("max_item"),
    ).withColumn("n_negative_seen", clash)
