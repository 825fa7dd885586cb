"""Train / test splits. Every split returns the rows with an ``is_test`` flag, or train and test frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import key_to_long, seeded_key
from ..functions.skew import dense_index, heavy_keys, lookup_join, number_in_group


def _test_size(n, ratio: float, keep: int):
    return F.greatest(F.lit(1), F.least(F.floor(n * F.lit(float(ratio))), n - F.lit(keep)))


def flag_stratified(df: DataFrame, test_ratio: float = 0.2, min_train: int = 2, user: str = "user_id",
                    order: tuple[str, ...] = ("ts", "row_key")) -> DataFrame:
    """Latest rows of each user to test; users with fewer than min_train + 1 rows stay in train."""
    ranked = number_in_group(df, user, list(order), "_pos", "_n", heavy_keys(df, user))
    test = (F.col("_n") >= min_train + 1) & (
        F.col("_pos") > F.col("_n") - _test_size(F.col("_n"), test_ratio, min_train))
    return ranked.withColumn("is_test", test).drop("_pos", "_n")


def flag_shuffled(df: DataFrame, test_ratio: float = 0.2, min_train: int = 2, seed: int = 42,
                  user: str = "user_id", row_key: str = "row_key") -> DataFrame:
    """flag_stratified without timestamps: rows of a user are ordered by a seeded hash."""
    keyed = df.withColumn("_h", seeded_key(seed, row_key))
    return flag_stratified(keyed, test_ratio, min_train, user, ("_h", row_key)).drop("_h")


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a flagged frame."""
    return (flagged.filter(~F.col("is_test")).drop("is_test"),
            flagged.filter(F.col("is_test")).drop("is_test"))


def stratified_split(df: DataFrame, test_ratio: float = 0.2, min_train: int = 2, user: str = "user_id",
                     order: tuple[str, ...] | None = ("ts", "row_key"), seed: int = 42,
                     row_key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    if order is None:
        return split(flag_shuffled(df, test_ratio, min_train, seed, user, row_key))
    return split(flag_stratified(df, test_ratio, min_train, user, order))


def temporal_split(df: DataFrame, test_ratio: float = 0.2, user: str = "user_id", item: str = "item_id",
                   order: tuple[str, ...] = ("ts", "row_key"), min_rows: int = 5,
                   keep: int = 3) -> tuple[DataFrame, DataFrame]:
    """Drop users below min_rows, latest rows to test, and only test items known to train."""
    ranked = number_in_group(df, user, list(order), "_pos", "_n", heavy_keys(df, user)).filter(F.col("_n") >= min_rows)
    is_test = F.col("_pos") > F.col("_n") - _test_size(F.col("_n"), test_ratio, keep)
    train = ranked.filter(~is_test).drop("_pos", "_n")
    test = ranked.filter(is_test).drop("_pos", "_n")
    known = train.select(item).distinct()
    return train, lookup_join(test, known, item, "left_semi", heavy_keys(df, item))


def contiguous_folds(df: DataFrame, order: list[str], folds: int = 5) -> DataFrame:
    """fold = position // (rows // folds) in row order; leftover rows join the last fold."""
    size = F.greatest(F.lit(1), F.floor(df.select(F.count(F.lit(1))).scalar() / folds))
    return dense_index(df, order, "_idx").withColumn(
        "fold", F.least(F.floor(F.col("_idx") / size), F.lit(folds - 1)).cast("int")).drop("_idx")


def all_but_n(df: DataFrame, start: int, stop: int, max_test: int = 0, user: str = "user_id",
              order: tuple[str, ...] = ("ts", "row_key")) -> DataFrame:
    """Each user's start-th to stop-th rows to test; with max_test > 0 only the first
    max_test of them in row order, the others back to train."""
    ranked = number_in_group(df, user, list(order), "_pos", None, heavy_keys(df, user))
    wanted = ranked.withColumn("is_test", F.col("_pos").between(start, stop)).drop("_pos")
    if max_test <= 0:
        return wanted
    numbered = dense_index(wanted.filter("is_test"), list(order), "_t")
    return (numbered.withColumn("is_test", F.col("_t") < max_test).drop("_t")
            .unionByName(wanted.filter("not is_test")))


def hashed_folds(df: DataFrame, folds: int = 3, seed: int = 42, row_key: str = "row_key") -> DataFrame:
    """Random fold per row from a seeded hash; a narrow column, no shuffle."""
    return df.withColumn("fold", F.pmod(key_to_long(seeded_key(seed, row_key)), F.lit(folds)).cast("int"))
