"""Pair statistics: rows sharing a key matched with each other and aggregated per pair.

One pass over user-item cells yields every statistic the similarity measures need, so a
measure never pays a second pair shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import heavy_keys, limits, lookup_join
from ..session import durable


def segments(rows: DataFrame, key: str, spread: list[str], parts: DataFrame, heavy: list) -> DataFrame:
    """Add _parts (segments of the key) and _seg (this row's segment, a hash of ``spread``)."""
    return lookup_join(rows, parts, key, "inner", heavy).withColumn(
        "_seg", F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"))


def parts_per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.ceil(F.count(F.lit(1)) / limits.segment_rows).cast("int").alias("_parts"))


def matched_pairs(cells: DataFrame, key: str, member: str, heavy: list | None = None) -> DataFrame:
    """Every unordered pair of rows sharing ``key``; columns a_<c>, b_<c> with a_member < b_member.

    A key with more than limits.segment_rows rows is cut into segments by a hash of the
    member, and segments are matched with each other: work on a large key spreads over
    (rows / segment_rows)^2 / 2 join keys instead of one task.
    """
    heavy = heavy_keys(cells, key) if heavy is None else heavy
    others = [c for c in cells.columns if c != key]
    rows = segments(cells, key, [member], parts_per_key(cells, key), heavy)
    left = rows.select(key, *[F.col(c).alias(f"l_{c}") for c in others], F.col("_seg").alias("_s1"),
                       F.explode(F.sequence("_seg", F.col("_parts") - 1)).alias("_s2"))
    right = rows.select(key, *[F.col(c).alias(f"r_{c}") for c in others], F.col("_seg").alias("_s2"),
                        F.explode(F.sequence(F.lit(0), F.col("_seg"))).alias("_s1"))
    ordered = F.col(f"l_{member}") < F.col(f"r_{member}")
    joined = left.join(right, [key, "_s1", "_s2"]).filter(ordered | (F.col("_s1") < F.col("_s2")))
    return joined.select(
        key,
        *[F.when(ordered, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"a_{c}") for c in others],
        *[F.when(ordered, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"b_{c}") for c in others],
    )


def matched_rows(left: DataFrame, right: DataFrame, key: str, left_member: str, right_member: str,
                 heavy: list | None = None) -> DataFrame:
    """All (left, right) row combinations sharing ``key``, as a join on ``key``.

    Both sides are segmented where ``right`` has many rows for a key, so a large key is
    worked on by (segments)^2 join keys. Column names of the sides must differ but for key.
    """
    heavy = heavy_keys(right, key) if heavy is None else heavy
    parts = parts_per_key(right, key)
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    lhs = segments(left, key, [left_member], parts, heavy)
    lhs = lhs.withColumnRenamed("_seg", "_s1").withColumn("_s2", every).drop("_parts")
    rhs = segments(right, key, [right_member], parts, heavy)
    rhs = rhs.withColumnRenamed("_seg", "_s2").withColumn("_s1", every).drop("_parts")
    return lhs.join(rhs, [key, "_s1", "_s2"]).drop("_s1", "_s2")


def with_item_stats(cells: DataFrame, weights: list[str], item: str = "item_id",
                    heavy: list | None = None) -> DataFrame:
    """Add per item: holders (users with a positive cell), and per weight sq_<w>, sum_<w>."""
    aggs = [F.count_if(F.col(weights[0]) > 0).alias("holders")]
    for w in weights:
        aggs += [F.sum(F.col(w) * F.col(w)).alias(f"sq_{w}"), F.sum(w).alias(f"sum_{w}")]
    return lookup_join(cells, cells.groupBy(item).agg(*aggs), item, "inner", heavy)


def pair_statistics(cells: DataFrame, weights: list[str] | None = None,
                    need: tuple[str, ...] = ("dot", "common", "cooc", "holders", "sq", "sum"),
                    user: str = "user_id", item: str = "item_id",
                    heavy_users: list | None = None, heavy_items: list | None = None, half: bool = True,
                    best: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b, statistics) for every item pair a < b sharing a user; without ``half`` both directions. ``best``: see pair_sums.

    ``need`` picks what is carried through the pair shuffle: cos_<w> (dot of unit item
    vectors), dot_<w>, common (users holding both), cooc (row pairs), holders_a/b,
    sq_<w>_a/b, sum_<w>_a/b.
    """
    weights = weights or ["w"]
    use_stats = {"cos", "holders", "sq", "sum"} & set(need)
    rows = cells.select(user, item, *weights, "n")
    if use_stats:
        rows = with_item_stats(rows, weights, item, heavy_items)
    sums, carried, keep = [], [], [user, item]
    for w in weights:
        if "cos" in need:
            norm = F.sqrt(F.col(f"sq_{w}"))
            rows = rows.withColumn(f"unit_{w}", F.when(norm > 0, F.col(w) / norm))
            keep.append(f"unit_{w}")
            sums.append(F.sum(F.col(f"a_unit_{w}") * F.col(f"b_unit_{w}")).alias(f"cos_{w}"))
        if "dot" in need:
            sums.append(F.sum(F.col(f"a_{w}") * F.col(f"b_{w}")).alias(f"dot_{w}"))
        if "dot" in need or "common" in need:
            keep.append(w)
        for stat in ("sq", "sum"):
            if stat in need:
                keep.append(f"{stat}_{w}")
                carried.append(f"{stat}_{w}")
    if "common" in need:
        both = (F.col(f"a_{weights[0]}") > 0) & (F.col(f"b_{weights[0]}") > 0)
        sums.append(F.count_if(both).alias("common"))
    if "cooc" in need:
        keep.append("n")
        sums.append(F.sum(F.col("a_n") * F.col("b_n")).alias("cooc"))
    if "holders" in need:
        keep.append("holders")
        carried.append("holders")
    carried = [F.max(f"{s}_{c}").alias(f"{c}_{s}") for c in carried for s in ("a", "b")]
    return pair_sums(rows.select(*dict.fromkeys(keep)), user, item, [*sums, *carried], heavy_users, heavy_items,
                     half=half, best=best)


def neighbor_statistics(cells: DataFrame, need: tuple[str, ...], user: str = "user_id", item: str = "item_id",
                        heavy_users: list | None = None, heavy_items: list | None = None,
                        only: DataFrame | None = None, best: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b, statistics) of pair_statistics for both directions of every pair, all rows of an ``a`` in one partition.

    See pair_sums: neither sums nor a rank per ``a`` shuffle the pairs. With ``best`` only what it picks of each ``a``.
    """
    rows = cells.select(user, item, *(["w"] if set(need) - {"cooc"} else []), "n")
    if {"cos", "holders", "sq", "sum"} & set(need):
        rows = with_item_stats(rows, ["w"], item, heavy_items)
    carried = {"cos": [("unit", F.when(F.col("sq_w") > 0, F.col("w") / F.sqrt("sq_w")))], "dot": [("w", F.col("w"))],
               "common": [("held", F.coalesce(F.col("w") > 0, F.lit(False)))], "cooc": [("n", F.col("n"))],
               "holders": [("holders", F.col("holders"))], "sq": [("sq_w", F.col("sq_w"))], "sum": [("sum_w", F.col("sum_w"))]}
    values = dict(v for what in need for v in carried[what])
    names = [item, *values]
    sums = {"cos": ("cos_w", F.sum(F.col("a_unit") * F.col("b_unit"))), "dot": ("dot_w", F.sum(F.col("a_w") * F.col("b_w"))),
            "common": ("common", F.count_if(F.col("a_held") & F.col("b_held"))),
            "cooc": ("cooc", F.sum(F.col("a_n") * F.col("b_n")))}
    kept = [n for n in values if n in ("holders", "sq_w", "sum_w")]
    return pair_sums(rows.select(user, item, *[c.alias(n) for n, c in values.items()]), user, item,
                     [*[sums[what][1].alias(sums[what][0]) for what in need if what in sums],
                      *[F.max(f"{s}_{n}").alias(f"{n}_{s}") for n in kept for s in ("a", "b")]],
                     heavy_users, heavy_items, only, best=best)


def pair_sums(rows: DataFrame, key: str, member: str, sums: list[Column], heavy_keys_: list | None = None,
              heavy_members: list | None = None, only: DataFrame | None = None, half: bool = False,
              best: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b, sums) for every pair of members sharing a key; ``sums`` are aggregates of a_<column> and b_<column>.

    A row of the only large shuffle is a member and the others of one of its keys, packed in arrays; pairs are built
    behind it, with all pairs of an ``a`` in one partition. With ``half`` only pairs a < b, else both directions; with
    ``only`` (a table of members) just the pairs with ``a`` in it. Keys are cut into segments like in matched_pairs;
    pairs of a member with many rows are summed up before their shuffle instead.

    ``best`` picks a few of the rows of each ``a``, independently of other members; only these are returned. Then the members
    are taken in rounds of about limits.round_pairs pairs, and the picked rows of a round are written before the next
    one starts, so that the disks hold the packed rows of one round, whatever the number of pairs.
    """
    names = [c for c in rows.columns if c != key]
    rows = rows if hasattr(rows, "durable_path") else durable(rows)
    heavy = heavy_keys(rows, key) if heavy_keys_ is None else heavy_keys_
    often = heavy_keys(rows, member) if heavy_members is None else heavy_members
    cut = segments(rows, key, [member], parts_per_key(rows, key), heavy)
    packed = cut.groupBy(key, "_seg").agg(F.collect_list(F.struct(*names)).alias("_l")).select(
        key, "_seg", *[F.col(f"_l.{n}").alias(f"l_{n}") for n in names])
    heads = cut if only is None else lookup_join(cut, only.select(member).distinct(), member, "left_semi", often)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    asked = counts.withColumn("h", F.col("m")) if only is None else counts.join(
        heads.groupBy(key).agg(F.count(F.lit(1)).alias("h")), key)
    work = asked.agg(F.sum(F.col("m") * F.col("h"))).first()[0] or 0
    width = max(1.0, len(names) / 4)  # a round has fewer pairs where these are wider than the four columns of a plain measure
    rounds = 1 if best is None else max(1, math.ceil(work * width / limits.round_pairs))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-work // (limits.task_pairs * rounds)), least)

    def summed(met: DataFrame) -> DataFrame:
        pairs = met.select(*[f"a_{n}" for n in names], F.inline(F.arrays_zip(*[F.col(f"l_{n}") for n in names])))
        pairs = pairs.withColumnsRenamed({f"l_{n}": f"b_{n}" for n in names}).filter(F.col(f"a_{member}") != F.col(f"b_{member}"))
        found = pairs.groupBy(F.col(f"a_{member}").alias("a"), F.col(f"b_{member}").alias("b")).agg(*sums)
        return found if best is None else best(found)

    def of_heads(heads: DataFrame, packed: DataFrame) -> DataFrame:
        one = heads.select(key, *[F.col(n).alias(f"a_{n}") for n in names],
                           F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_seg"))
        met = one.repartition(parts, key, "_seg").join(packed.repartition(parts, key, "_seg"), [key, "_seg"]).drop(key, "_seg")
        if half:
            later = F.filter(F.arrays_zip(*[F.col(f"l_{n}") for n in names]), lambda x: x[f"l_{member}"] > F.col(f"a_{member}"))
            met = met.select(*[f"a_{n}" for n in names], later.alias("_l")).filter(F.size("_l") > 0)
            met = met.select(*[f"a_{n}" for n in names], *[F.col(f"_l.l_{n}").alias(f"l_{n}") for n in names])
        if not often:
            return summed(met.repartition(parts, f"a_{member}"))
        is_often = F.col(f"a_{member}").isin(list(often))
        return summed(met.filter(~is_often).repartition(parts, f"a_{member}")).unionByName(summed(met.filter(is_often)))

    if rounds == 1:
        return of_heads(heads, packed)
    heads, packed = durable(heads), durable(packed)
    turn = F.pmod(F.xxhash64(F.lit("round"), member), F.lit(rounds))
    return reduce(DataFrame.unionByName, [durable(of_heads(heads.filter(turn == r), packed)) for r in range(rounds)])


def both_directions(pairs: DataFrame, a: str = "a", b: str = "b", item: str = "item_id",
                    values: tuple[str, ...] = ("sim",)) -> DataFrame:
    """Mirror symmetric pairs in a single pass: (item, neighbor, values)."""
    one = F.struct(F.col(a).alias(item), F.col(b).alias("neighbor"))
    two = F.struct(F.col(b).alias(item), F.col(a).alias("neighbor"))
    return (pairs.select(F.explode(F.array(one, two)).alias("_d"), *values)
            .select(f"_d.{item}", "_d.neighbor", *values))
