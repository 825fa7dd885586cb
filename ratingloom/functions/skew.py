"""Joins and ranks that stay balanced when one key holds a large part of all rows.

Every helper is exact. Keys are "heavy" from ``limits.heavy_rows`` rows on. The list of heavy keys
is bounded by ``limits.heavy_keys``: any key beyond it holds less than 1/65536 of all rows. How many
salts a key gets follows from its own rows, how many slices from the number of shuffle partitions, so
both grow with the data.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from ..session import durable


@dataclass
class Limits:
    heavy_rows: int = 200_000
    heavy_keys: int = 65_536
    slices: int = 1024  # at least
    segment_rows: int = 2048
    task_pairs: int = 4_000_000  # pairs that a task sums up, on average
    round_pairs: int = 400_000_000  # pairs whose packed rows are on the disks at a time, where few rows of them are kept


limits = Limits()


class Heavy(list):
    """Heavy keys with the number of parts, of heavy_rows rows, that each is spread over; ``kind``: their type."""

    def __init__(self, rows: dict, kind: DataType):
        super().__init__(rows)
        self.salts = {k: max(-(-n // limits.heavy_rows), 2) for k, n in rows.items()}
        self.kind = kind

    def table(self, spark: SparkSession, key: str) -> DataFrame:
        """(key, _salts), at most limits.heavy_keys rows."""
        schema = StructType([StructField(key, self.kind), StructField("_salts", LongType())])
        return spark.createDataFrame(list(self.salts.items()), schema)


_known: OrderedDict[tuple, Heavy] = OrderedDict()


def heavy_keys(df: DataFrame, key: str) -> Heavy:
    """The largest keys of ``df``, at most limits.heavy_keys values; one small job.

    The list only balances work, no result depends on it, so it is remembered per plan.
    """
    memo = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), key, limits.heavy_rows)
    if memo not in _known:
        top = (
            df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= limits.heavy_rows) & F.col("k").isNotNull())
            .orderBy(F.desc("n"), "k").limit(limits.heavy_keys)
        )
        rows = top.collect()
        _known[memo] = Heavy({r["k"]: r["n"] for r in rows}, top.schema["k"].dataType)
        if len(_known) > 256:
            _known.popitem(last=False)
    return _known[memo]


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left",
                heavy: Heavy | None = None) -> DataFrame:
    """Join ``rows`` with a per-key ``table`` on ``key``.

    With ``heavy`` (see heavy_keys) the rows of a heavy key are spread over several join
    keys, as many as that key's rows need, and the few table rows of that key are repeated as
    often, so no task gets a whole heavy key. Works for inner, left, left_semi and left_anti. Only
    the bounded list of heavy keys has a broadcast hint: Spark broadcasts the table only where
    its measured size allows.
    """
    if not heavy:
        return rows.join(table, key, how)
    salts = F.broadcast(heavy.table(rows.sparkSession, key))
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key] or [key]), F.coalesce("_salts", F.lit(1)))
    left = rows.join(salts, key, "left").select(*rows.columns, spread.alias("_salt"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))
    right = table.join(salts, key, "left").select(*table.columns, copies.alias("_salt"))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _order_key(order: list[str]) -> Column:
    return F.struct(*order)


def _slices(df: DataFrame) -> int:
    """Four slices for each shuffle partition, as the user sizes these to the data."""
    return max(limits.slices, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(df: DataFrame, order: list[str]) -> Column:
    """Literal sorted array of at most _slices - 1 order keys, a hash sample of ``df``'s rows.

    One small job; the sample is fixed in the plan, so a recomputed task sees the same cuts.
    """
    sample = (
        df.select(_order_key(order).alias("_o"))
        .orderBy(F.xxhash64("_o"), "_o").limit(_slices(df) - 1)
        .agg(F.array_sort(F.collect_list("_o")).alias("_cuts"))
    )
    text = sample.select(F.to_json("_cuts").alias("j")).first()["j"]
    return F.from_json(F.lit(text), sample.schema["_cuts"].dataType)


def _slice_of(cuts: Column, key: Column, slices: int) -> Column:
    """Number of cuts <= key, by halving steps over the sorted array."""
    steps, p = [], 1
    while p < slices:
        steps.append(p)
        p *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0),
        lambda acc, s: F.when(F.get(cuts, acc + s - F.lit(1)) <= key, acc + s).otherwise(acc),
    )


def number_in_group(rows: DataFrame, key: str, order: list[str], pos: str = "pos",
                    size: str | None = "n", heavy: list | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group (and the group size).

    The rows of a heavy key are cut into order-preserving slices that are numbered
    separately and shifted by the number of rows in earlier slices, so the largest window
    holds about 1/slices of the heavy rows.
    """
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    if not heavy:
        out = rows.withColumn(pos, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
        return out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(key))) if size else out
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    cuts = _cuts(rows.filter(is_heavy), order)
    sliced = rows.withColumn("_slice", F.when(is_heavy, _slice_of(cuts, _order_key(order), _slices(rows))).otherwise(0))
    in_slice = Window.partitionBy(key, "_slice")
    out = sliced.withColumn("_rn", F.row_number().over(in_slice.orderBy(*order)))
    if size:
        out = out.withColumn("_cnt", F.count(F.lit(1)).over(in_slice))
    per_slice = sliced.filter(is_heavy).groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_slice.select(
        key, "_slice",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(key)).alias("_total"),
    )
    # at most heavy_keys * slices rows
    out = out.join(F.broadcast(shift), [key, "_slice"], "left")
    out = out.withColumn(pos, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("bigint"))
    if size:
        out = out.withColumn(size, F.coalesce("_total", "_cnt").cast("bigint"))
    return out.drop("_slice", "_rn", "_cnt", "_before", "_total")


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str,
                heavy: list | None = None) -> DataFrame:
    """Add the running sum of ``value`` (bigint) within the group, sliced like number_in_group."""
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not heavy:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(*upto)))
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    cuts = _cuts(rows.filter(is_heavy), order)
    sliced = rows.withColumn("_slice", F.when(is_heavy, _slice_of(cuts, _order_key(order), _slices(rows))).otherwise(0))
    in_slice = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(*upto)
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (sliced.filter(is_heavy).groupBy(key, "_slice").agg(F.sum(value).alias("_c"))
             .select(key, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")))
    out = sliced.withColumn("_run", F.sum(value).over(in_slice)).join(F.broadcast(shift), [key, "_slice"], "left")
    return (out.withColumn(name, F.col("_run") + F.coalesce("_before", F.lit(0)))
            .drop("_slice", "_run", "_before"))


def dense_index(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in the total order ``order`` (must be unique).

    Replaces a one-task global row_number: rows are dealt into ranges, sorted there, and shifted by the number of rows
    in earlier ranges. The sorted rows are written once, so that counts and positions see the same ranges; the columns
    of ``rows`` should be those that are needed.
    """
    # a range's number stands above the 33 bits of the place in it
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shift = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part).join(F.broadcast(shift), "_part")
        .withColumn(name, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).cast("bigint"))
        .drop("_part", "_at", "_before")
    )


def first_in_order(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Exactly the first ``n`` rows in ``order``.

    Rows behind a cut that surely has ``n`` rows up to it are left out before the rest is sorted; one comparison a row.
    """
    total, steps = rows.count(), _slices(rows)
    if n <= 0 or n >= total:
        return rows.limit(0) if n <= 0 else rows
    share = n / total * (steps - 1)
    nr = int(share + 6 * math.sqrt(share) + 6)  # the cut's number: far above that of the n-th row
    few = rows
    if total > limits.heavy_rows and nr < steps - 1:
        few = durable(rows.filter(_order_key(order) <= F.get(_cuts(rows, order), F.lit(nr))))
        few = few if few.count() >= n else rows
    return dense_index(few, order, "_i").filter(F.col("_i") < n).drop("_i")


def _lowest(rows: DataFrame, n: int, order: list[str], bucket: Column) -> DataFrame:
    """Exactly the first n rows in ``order``, given an order-preserving bucket column.

    Rows are counted per bucket; whole buckets below the boundary are kept as they are and only the
    boundary bucket is ranked. A large one (many ties) goes through first_in_order.
    """
    tagged = rows.withColumn("_b", bucket)
    counts = tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = (
        counts.withColumn("_cum", F.sum("_c").over(upto))
        .filter(F.col("_cum") - F.col("_c") < n)
        .select("_b", (F.lit(n) - (F.col("_cum") - F.col("_c"))).alias("_take"), "_c")
    )
    # a row per bucket, no more than n
    kept = tagged.join(F.broadcast(need) if n <= limits.heavy_keys else need, "_b")
    whole = kept.filter(F.col("_take") >= F.col("_c")).drop("_b", "_take", "_c")
    edge = need.filter(F.col("_take") < F.col("_c")).first()
    if edge is None:
        return whole
    inside = tagged.filter(F.col("_b") == F.lit(edge["_b"])).drop("_b")
    if edge["_c"] > limits.heavy_rows:
        return whole.unionByName(first_in_order(inside, edge["_take"], order))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # one bucket, at most heavy_rows rows
    return whole.unionByName(inside.withColumn("_rn", rank).filter(F.col("_rn") <= edge["_take"]).drop("_rn"))


def lowest_by_key(rows: DataFrame, n: int, hex_key: str, tie: str) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hex key (ties by ``tie``)."""
    return _lowest(rows, n, [hex_key, tie], F.substring(hex_key, 1, 4))


def lowest_by_key(rows: DataFrame, n: int, hex_key: str, tie: str) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hex key (ties by ``tie``)."""
    return _lowest(rows, n, [hex_key, tie], F.substring(hex_key, 1, 4))


def top_per_group(rows: DataFrame, key: str | list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; the rank filter lets Spark cut each group before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    return (rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint")))
