"""Item-item (and user-user) similarity from pair statistics.

All measures keep neighbours with sim > min_similarity, best k per item, ties by id. Only
pairs sharing a user can qualify when weights are non-negative and min_similarity >= 0, so
the sparse pair table is enough and exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import score
from ..functions.skew import heavy_keys, top_per_group
from ..session import durable
from .pairs import both_directions, matched_pairs, neighbor_statistics, pair_statistics, pair_sums
from .rater_blocks import meet_often, pair_similarities

NEEDS = {
    "enhanced_cosine": ("cos", "cooc"),
    "jaccard": ("common", "cooc", "holders"),
    "tanimoto": ("dot", "sq"),
    "pearson": ("dot", "sq", "sum"),
}


def resolve_method(name: str) -> str:
    """Unknown measure names mean enhanced_cosine."""
    return name if name in NEEDS else "enhanced_cosine"


def _measure(method: str, w: str, n_users: Column | None) -> Column:
    boost = F.lit(1.0) + F.col("cooc") / F.lit(100.0) if method in ("enhanced_cosine", "jaccard") else None
    if method == "enhanced_cosine":
        return F.col(f"cos_{w}") * boost
    if method == "jaccard":
        return F.col("common") / (F.col("holders_a") + F.col("holders_b") - F.col("common")) * boost
    dot = F.col(f"dot_{w}")
    if method == "tanimoto":
        rest = F.col(f"sq_{w}_a") + F.col(f"sq_{w}_b") - dot
        return F.when(rest > 0, dot / rest)
    mean = {s: F.col(f"sum_{w}_{s}") / n_users for s in ("a", "b")}
    spread = {s: F.col(f"sq_{w}_{s}") - n_users * mean[s] * mean[s] for s in ("a", "b")}
    product = F.sqrt(spread["a"]) * F.sqrt(spread["b"])
    return F.when(product > 0, (dot - n_users * mean["a"] * mean["b"]) / product)


def neighbors_from_pairs(pairs: DataFrame, method: str = "enhanced_cosine", k: int = 50,
                         min_similarity: float = 0.0001, idf: DataFrame | None = None,
                         n_users: Column | None = None, w: str = "w", item: str = "item_id") -> DataFrame:
    """(item, neighbor, sim, rank) from a pair_statistics frame.

    With ``idf`` the row item's idf scales its whole list: the order inside a list does not
    depend on it, so it is applied after the top k, to k rows per item instead of all pairs.
    """
    if min_similarity < 0:
        raise ValueError("min_similarity must be >= 0: pairs without a shared user are never built")
    return _best(pairs, method, k, min_similarity, idf, n_users, w, item, False)


def _best(pairs: DataFrame, method: str, k: int, min_similarity: float, idf: DataFrame | None, n_users: Column | None,
          w: str, item: str, directed: bool) -> DataFrame:
    """The best neighbours; ``directed``: ``pairs`` has both directions of every pair."""
    method = resolve_method(method)
    base = pairs.select("a", "b", score(_measure(method, w, n_users)).alias("sim")).filter(F.col("sim") > 0)
    floor = F.col("sim") > F.lit(float(min_similarity))
    scaled = method == "enhanced_cosine" and idf is not None
    base = base if scaled else base.filter(floor)
    rows = base.withColumnsRenamed({"a": item, "b": "neighbor"}) if directed else both_directions(base, item=item)
    best = top_per_group(rows, item, [F.desc("sim"), F.asc("neighbor")], k)
    if scaled:
        best = (best.join(idf.select(item, "idf"), item)
                .withColumn("sim", score(F.col("sim") * F.col("idf"))).drop("idf").filter(floor))
    return best.select(item, "neighbor", "sim", "rank")


@dataclass(frozen=True)
class NeighborList:
    """How a list of neighbours is picked: the parameters of neighbors_from_pairs."""

    method: str
    k: int
    min_similarity: float
    use_idf: bool
    w: str


def neighbor_lists(pairs: DataFrame, lists: list[NeighborList], idf: DataFrame, n_users: Column, item: str = "item_id") -> DataFrame:
    """(setting, item, neighbor, sim, rank): neighbors_from_pairs of several settings, numbered, in one pass.

    ``pairs`` has both directions of every pair, all rows of an ``a`` in one partition: the ranks shuffle nothing.
    """
    if any(x.min_similarity < 0 for x in lists):
        raise ValueError("min_similarity must be >= 0: pairs without a shared user are never built")
    scaled = [x.use_idf and resolve_method(x.method) == "enhanced_cosine" for x in lists]
    each = pairs.select("a", "b", *[score(_measure(resolve_method(x.method), x.w, n_users)).alias(f"s{i}") for i, x in enumerate(lists)])
    for i, x in enumerate(lists):
        low = F.lit(0.0 if scaled[i] else float(x.min_similarity))
        each = each.withColumn(f"s{i}", F.when(F.col(f"s{i}") > low, F.col(f"s{i}")))
        each = each.withColumn(f"r{i}", F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last(f"s{i}"), F.asc("b"))))
    picked = [F.when(F.col(f"s{i}").isNotNull() & (F.col(f"r{i}") <= x.k), F.struct(
        F.lit(i).alias("setting"), F.col(f"s{i}").alias("sim"), F.col(f"r{i}").cast("bigint").alias("rank"))) for i, x in enumerate(lists)]
    few = each.select("a", "b", F.explode(F.array_compact(F.array(*picked))).alias("_p")).select(
        F.col("_p.setting").alias("setting"), F.col("a").alias(item), F.col("b").alias("neighbor"), "_p.sim", "_p.rank")
    if any(scaled):
        boosted = F.col("setting").isin([i for i, s in enumerate(scaled) if s])
        floor = F.get(F.array(*[F.lit(float(x.min_similarity)) for x in lists]), F.col("setting"))
        few = few.join(idf.select(item, "idf"), item, "left").withColumn(
            "sim", F.when(boosted, score(F.col("sim") * F.col("idf"))).otherwise(F.col("sim"))).filter(F.col("sim") > floor)
    return few.select("setting", item, "neighbor", "sim", "rank")


def item_neighbors(cells: DataFrame, method: str = "enhanced_cosine", k: int = 50,
                   min_similarity: float = 0.0001, idf: DataFrame | None = None,
                   user: str = "user_id", item: str = "item_id",
                   heavy_users: list | None = None, heavy_items: list | None = None) -> DataFrame:
    """Top-k neighbours per item straight from user-item cells."""
    method = resolve_method(method)
    if min_similarity < 0:
        raise ValueError("min_similarity must be >= 0: pairs without a shared user are never built")
    n_users = cells.select(F.count_distinct(user)).scalar() if method == "pearson" else None
    return neighbor_statistics(cells, NEEDS[method], user, item, heavy_users, heavy_items,
                               best=lambda pairs: _best(pairs, method, k, min_similarity, idf, n_users, "w", item, True))


def cooccurrence(cells: DataFrame, user: str = "user_id", item: str = "item_id",
                 heavy: list | None = None) -> DataFrame:
    """(item, neighbor, n): row pairs of the same user, both directions, multiplicities multiply.

    The self cell n * (n - 1) of repeated items is included.
    """
    pairs = pair_statistics(cells.withColumn("w", F.lit(1.0)), ["w"], ("cooc",), user, item, heavy)
    both = both_directions(pairs, item=item, values=("cooc",)).withColumnRenamed("cooc", "n")
    own = (cells.groupBy(item).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("n")).filter("n > 0")
           .select(item, F.col(item).alias("neighbor"), "n"))
    return both.unionByName(own)


def common_rater_similarity(ratings: DataFrame, measure: str = "cosine", user_based: bool = False,
                            min_support: int = 1, user: str = "user_id", item: str = "item_id",
                            rating: str = "rating") -> DataFrame:
    """(a, b, support, sim) over common raters only; cosine or msd, 0 below min_support.

    ``ratings`` holds one row per (user, item). user_based swaps the roles. Where members share many keys, all pairs of
    members are compared by blocks (see rater_blocks).
    """
    key, member = (item, user) if user_based else (user, item)
    rows = durable(ratings.select(key, member, F.col(rating).alias("r")))
    size = meet_often(rows, member, key, "r")
    if size:
        return pair_similarities(rows, member, key, size, measure, min_support, "r")
    return similarity_from_common(pair_sums(rows, key, member, _common_sums(), half=True), measure, min_support)


def common_rater_statistics(ratings: DataFrame, user_based: bool = False, user: str = "user_id",
                            item: str = "item_id", rating: str = "rating") -> DataFrame:
    """(a, b, support, ab, aa, bb, dd): sums over common raters shared by all measures."""
    key, member = (item, user) if user_based else (user, item)
    rows = ratings.select(key, member, F.col(rating).alias("r"))
    return pair_sums(rows, key, member, _common_sums(), half=True)


def fold_rater_statistics(folds: DataFrame, user_based: bool = False, n_folds: int = 3) -> DataFrame:
    """(fold, a, b, support, ab, aa, bb, dd): common_rater_statistics of the rows outside each fold, in one pass.

    ``folds`` is (user_id, item_id, rating, fold).
    """
    key, member = ("item_id", "user_id") if user_based else ("user_id", "item_id")
    rows = training_copies(folds, n_folds).select(F.struct(key, "fold").alias("_k"), member, F.col("rating").alias("r"))
    pairs = matched_pairs(rows, "_k", member, heavy_keys(rows, "_k"))
    return pairs.groupBy(F.col("_k.fold").alias("fold"), F.col(f"a_{member}").alias("a"),
                         F.col(f"b_{member}").alias("b")).agg(*_common_sums())


def training_copies(folds: DataFrame, n_folds: int = 3) -> DataFrame:
    """Every row once for each fold that it trains, that is all but its own; ``fold`` is the one that it trains."""
    copies = folds.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).filter(F.col("_f") != F.col("fold"))
    return copies.withColumn("fold", F.col("_f")).drop("_f")


def _common_sums() -> list:
    gap = F.col("a_r") - F.col("b_r")
    return [F.count(F.lit(1)).alias("support"),
            F.sum(F.col("a_r") * F.col("b_r")).alias("ab"), F.sum(F.col("a_r") * F.col("a_r")).alias("aa"),
            F.sum(F.col("b_r") * F.col("b_r")).alias("bb"), F.sum(gap * gap).alias("dd")]


def similarity_from_common(stats: DataFrame, measure: str = "cosine", min_support: int = 1,
                           keep: tuple[str, ...] = ()) -> DataFrame:
    """Similarity of common_rater_statistics rows: cosine or 1 / (msd + 1); columns ``keep`` are carried along."""
    return stats.select(*keep, "a", "b", "support", common_similarity(measure, min_support).alias("sim"))


def common_similarity(measure: str = "cosine", min_support: int = 1) -> Column:
    """The similarity of a row of common-rater sums, 0 below min_support."""
    if measure == "msd":
        value = F.lit(1.0) / (F.col("dd") / F.col("support") + 1)
    else:
        norm = F.sqrt(F.col("aa") * F.col("bb"))
        value = F.when(norm > 0, F.col("ab") / norm).otherwise(F.lit(0.0))
    return score(F.when(F.col("support") >= min_support, value).otherwise(F.lit(0.0)))
