"""Item-based top-N recommendation for all users in one batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import SCORE_DIGITS, score
from ..functions.skew import heavy_keys, limits, lookup_join, number_in_group, top_per_group
from ..session import durable
from .cleaning import adaptive_core, require_rows
from .pairs import neighbor_statistics
from .popularity import item_popularity, popular_for, popular_items
from .similarity import item_neighbors
from .weights import interaction_weight, item_idf, user_item_cells


@dataclass(frozen=True)
class Settings:
    """Recommender parameters; the defaults are the published ones of the job."""

    k: int = 50
    similarity_method: str = "enhanced_cosine"
    min_similarity: float = 0.0001
    min_interactions: int = 1
    implicit_feedback: bool = True
    popularity_weight: float = 0.2
    time_decay_factor: float = 0.95
    use_idf_weighting: bool = True
    name: str = "default"


@dataclass(frozen=True)
class ItemModel:
    """A fitted model: every part is a DataFrame."""

    settings: Settings
    sim: DataFrame
    cells: DataFrame
    popularity: DataFrame
    popular: DataFrame
    heavy_items: list


def fit(df: DataFrame, settings: Settings = Settings(), ts: str | None = "ts",
        rating: str | None = "rating", minimum_rows: int = 50, sim: DataFrame | None = None) -> ItemModel:
    """Clean, weight, and learn neighbours and popularity from interactions (user_id, item_id, ..).

    ``sim`` takes ready neighbours, so that several settings can share one pair pass.
    """
    df = require_rows(adaptive_core(df, settings.min_interactions), minimum_rows)
    users, items = heavy_keys(df, "user_id"), heavy_keys(df, "item_id")
    decay = settings.time_decay_factor if ts else None
    cells = durable(user_item_cells(interaction_weight(df, settings.implicit_feedback, decay, rating, ts or "ts")))
    idf = item_idf(cells) if settings.use_idf_weighting else None
    if sim is None:
        sim = durable(item_neighbors(cells, settings.similarity_method, settings.k, settings.min_similarity, idf,
                                     heavy_users=users, heavy_items=items))
    popularity = durable(item_popularity(df, decay))
    return ItemModel(settings, sim, cells, popularity, popular_items(popularity), items)


def history_weights(rows: DataFrame, decay: float = 0.95, order: tuple[str, ...] = ("ts", "row_key"),
                    user: str = "user_id") -> DataFrame:
    """Add pos, n and weight = decay^(n - pos) / sum of these over the user's rows.

    The sum is a geometric series in n, so no second pass over the user is needed.
    """
    ranked = number_in_group(rows, user, list(order), "pos", "n", heavy_keys(rows, user))
    raw = F.pow(F.lit(float(decay)), F.col("n") - F.col("pos"))
    total = (F.col("n").cast("double") if decay == 1
             else (F.lit(1.0) - F.pow(F.lit(float(decay)), F.col("n"))) / F.lit(1.0 - decay))
    return ranked.withColumn("weight", raw / total)


def history_cells(rows: DataFrame, decay: float = 0.95, recent: int = 10, tail: int = 5,
                  order: tuple[str, ...] = ("ts", "row_key")) -> DataFrame:
    """One row per (user, item): weight (repeats add up), pos of the last row, recent and in_tail flags.

    recent marks the user's latest distinct items, in_tail items among the last rows.
    """
    ranked = history_weights(rows, decay, order)
    cells = ranked.groupBy("user_id", "item_id").agg(
        F.sum("weight").alias("weight"), F.max("pos").alias("pos"),
        F.min(F.when(F.col("pos") > F.col("n") - tail, F.col("pos"))).alias("tail_pos"))
    latest = top_per_group(cells.select("user_id", "item_id", "pos"), "user_id", [F.desc("pos")], recent, "_r")
    return cells.join(latest.select("user_id", "item_id", F.lit(True).alias("recent")),
                      ["user_id", "item_id"], "left").withColumn("recent", F.coalesce("recent", F.lit(False)))


def scored_candidates(history: DataFrame, sim: DataFrame, heavy_items: list | None = None,
                      popularity: DataFrame | None = None,
                      best: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(user, item, score, closeness): unseen neighbours, summed sim x weight over the history.

    closeness is the largest similarity to the user's recent items (0 if none); it comes out
    of the same aggregation. With ``popularity`` (item_id, pop) a candidate also has its pop, with ``best`` only the
    rows that it picks of each user are returned.

    A row of the only large shuffle is a history row with the neighbours of its item, packed in arrays; candidates are
    built and summed up behind it, with all rows of a user in one task, and seen items are told apart by a marker of
    their own. Users with many rows are summed up before their shuffle instead. With ``best`` the users are taken in rounds
    of about limits.round_pairs candidates; the picked rows of a round are written before the next one starts.
    """
    neighbors = sim.select("item_id", F.col("neighbor").alias("id"), "sim")
    if popularity is not None:
        neighbors = neighbors.join(popularity.select(F.col("item_id").alias("id"), "pop"), "id", "left")
    names = [c for c in neighbors.columns if c not in ("item_id", "id")]
    ids, units, narrow = _narrow(sim)
    values = {n: units("sim") if n == "sim" else F.coalesce(n, F.lit(0.0)) for n in names}
    lists = durable(neighbors.groupBy("item_id").agg(F.collect_list(F.struct(ids("id").alias("id"), *[v.alias(n) for n, v in values.items()])).alias("_l"))
                    .select("item_id", *[F.col(f"_l.{n}").alias(f"l_{n}") for n in ["id", *names]]))
    rows = history.select("user_id", "item_id", "weight", "recent")
    longest = lists.agg(F.max(F.size("l_id"))).first()[0] or 0
    work = history.count() * (longest + 1)
    rounds = 1 if best is None else max(1, -(-work // limits.round_pairs))
    parts = max(-(-work // (limits.task_pairs * rounds)), int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = heavy_keys(history, "user_id")

    def summed(packed: DataFrame) -> DataFrame:
        listed = F.arrays_zip(*[F.col(f"l_{n}").alias(n) for n in ["id", *names]])
        listed = F.transform(listed, lambda x: F.struct(x["id"].cast("bigint").alias("id"), *[
            (narrow(x[n]) if n == "sim" else x[n]).alias(n) for n in names])) if narrow else listed
        own = F.array(F.struct(F.col("item_id").alias("id"), *[F.lit(None).cast("double").alias(n) for n in names]))
        each = packed.select("user_id", "weight", "recent", F.inline(F.when(F.col("l_id").isNull(), own).otherwise(F.concat(own, listed))))
        grouped = each.groupBy("user_id", F.col("id").alias("item_id")).agg(
            F.sum(F.col("sim") * F.col("weight")).alias("score"),
            F.coalesce(F.max(F.when(F.col("recent"), F.col("sim"))), F.lit(0.0)).alias("closeness"),
            *[F.max(n).alias(n) for n in names if n != "sim"], F.bool_or(F.col("sim").isNull()).alias("_seen"))
        found = grouped.filter("NOT _seen").drop("_seen")
        return found if best is None else best(found)

    def of_users(rows: DataFrame) -> DataFrame:
        packed = lookup_join(rows, lists, "item_id", "left", heavy_items)
        if not often:
            return summed(packed.repartition(parts, "user_id"))
        is_often = F.coalesce(F.col("user_id").isin(list(often)), F.lit(False))
        return summed(packed.filter(~is_often).repartition(parts, "user_id")).unionByName(summed(packed.filter(is_often)))

    if rounds == 1:
        return of_users(rows)
    turn = F.pmod(F.xxhash64(F.lit("round"), "user_id"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [durable(of_users(rows.filter(turn == r))) for r in range(rounds)])


def _narrow(sim: DataFrame) -> tuple[Callable[[str], Column], Callable[[str], Column], Callable[[Column], Column] | None]:
    """How ids and similarities are packed, and how a similarity is unpacked (None: as they are).

    Half the bytes, without any loss, where all ids and all similarities in units of score() fit into 32 bits.
    """
    unit, most = F.lit(float(10 ** SCORE_DIGITS)), (1 << 31) - 1
    if sim.schema["neighbor"].dataType.simpleString() == "bigint":
        whole = F.round(F.col("sim") * unit).cast("bigint")
        fits = (F.abs("neighbor") <= most) & (F.abs(whole) <= most) & (whole / unit == F.col("sim"))
        if sim.agg(F.bool_and(F.coalesce(fits, F.lit(False)))).first()[0]:
            return (lambda c: F.col(c).cast("int"), lambda c: F.round(F.col(c) * unit).cast("int"), lambda c: c / unit)
    return F.col, F.col, None


def cooccurrence_backfill(history: DataFrame, cells: DataFrame, candidates: DataFrame, top_n: int = 10,
                          most: int = 20) -> DataFrame:
    """(user, item, score): for users with fewer than 2 * top_n candidates, the items most often
    held together with their latest rows; score = count / 100, the earliest history row wins.

    Co-occurrence is built only for the items those users need.
    """
    sizes = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
    tails = history.filter(F.col("tail_pos").isNotNull()).select("user_id", "item_id", "tail_pos")
    short = (tails.join(sizes, "user_id", "left").filter(F.coalesce("_c", F.lit(0)) < 2 * top_n).drop("_c"))
    wanted = short.select("item_id").distinct()
    items = heavy_keys(cells, "item_id")

    def most_met(pairs: DataFrame) -> DataFrame:
        rows = pairs.select(F.col("a").alias("head"), F.col("b").alias("candidate"), "cooc")
        return top_per_group(rows, "head", [F.desc("cooc"), F.asc("candidate")], most, "_r").drop("_r")

    met = neighbor_statistics(cells, ("cooc",), heavy_items=items, only=wanted, best=most_met)
    own = lookup_join(cells, wanted, "item_id", "left_semi", items).groupBy(F.col("item_id").alias("head")).agg(
        F.sum(F.col("n") * (F.col("n") - 1)).alias("cooc")).select("head", F.col("head").alias("candidate"), "cooc")
    counts = met.unionByName(own).filter("cooc > 0")
    top = top_per_group(counts, "head", [F.desc("cooc"), F.asc("candidate")], most, "_r")
    offered = short.join(top, F.col("item_id") == F.col("head")).groupBy(
        "user_id", F.col("candidate").alias("item_id")).agg(
        (F.min_by("cooc", "tail_pos") / F.lit(100.0)).alias("score"))
    known = candidates.select("user_id", "item_id").unionByName(history.select("user_id", "item_id"))
    return offered.join(known, ["user_id", "item_id"], "left_anti")


def _penalty_score(popularity_weight: float, diversity: float) -> Column:
    """(score + pop * weight) * (1 - diversity * closeness)."""
    base = F.col("score") + F.coalesce("pop", F.lit(0.0)) * F.lit(float(popularity_weight))
    return score(base * (F.lit(1.0) - F.lit(float(diversity)) * F.col("closeness")))


def penalised(candidates: DataFrame, popularity: DataFrame, popularity_weight: float = 0.2,
              diversity: float = 0.2) -> DataFrame:
    """(user, item, score): (score + pop * weight) * (1 - diversity * closeness)."""
    joined = candidates.join(popularity.select("item_id", "pop"), "item_id", "left")
    return joined.select("user_id", "item_id", _penalty_score(popularity_weight, diversity).alias("score"))


@dataclass(frozen=True)
class Candidates:
    """History cells of all users and their best 2 * top_n candidates with penalised scores, for lists of at most top_n.

    A user with fewer candidates has all of them, so that the back-fill knows whom it serves.
    """

    history: DataFrame
    found: DataFrame
    top_n: int
    diversity: float


def prepare(model: ItemModel, rows: DataFrame, top_n: int = 10, diversity: float = 0.2) -> Candidates:
    """Candidates for the users in ``rows``, written once: back-fill and ranking both read them."""
    history = durable(history_cells(rows, model.settings.time_decay_factor))
    order = [F.desc("score"), F.asc("item_id")]

    def best(found: DataFrame) -> DataFrame:
        scores = found.select("user_id", "item_id", _penalty_score(model.settings.popularity_weight, diversity).alias("score"))
        return top_per_group(scores, "user_id", order, 2 * top_n).drop("rank")

    found = durable(scored_candidates(history, model.sim, model.heavy_items, model.popularity, best))
    return Candidates(history, found, top_n, diversity)


def finish(model: ItemModel, candidates: Candidates, top_n: int | None = None, users: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank) from prepared candidates."""
    top_n = candidates.top_n if top_n is None else top_n
    if top_n > candidates.top_n:
        raise ValueError(f"candidates were prepared for lists of at most {candidates.top_n}")
    history, found = candidates.history, candidates.found
    extra = cooccurrence_backfill(history, model.cells, found, top_n).withColumn("closeness", F.lit(0.0))
    filled = penalised(extra, model.popularity, model.settings.popularity_weight, candidates.diversity)
    final = found.unionByName(filled)
    best = durable(top_per_group(final, "user_id", [F.desc("score"), F.asc("item_id")], top_n))
    everyone = history.select("user_id").distinct()
    if users is not None:
        everyone = everyone.unionByName(users.select("user_id")).distinct()
    without = everyone.join(best.select("user_id").distinct(), "user_id", "left_anti")
    return best.unionByName(popular_for(without, history, model.popular, top_n))


def recommend(model: ItemModel, rows: DataFrame, top_n: int = 10, diversity: float = 0.2,
              users: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank): top_n per user with a history in ``rows``.

    Users without any scored candidate, and users of ``users`` without history, get popular items.
    """
    return finish(model, prepare(model, rows, top_n, diversity), users=users)


def blend(parts: list[tuple[DataFrame, float]], top_n: int = 10) -> DataFrame:
    """Weighted sum of scored lists, top_n per user. Each part is (recommendations, weight)."""
    scaled = [p.select("user_id", "item_id", (F.col("score") * F.lit(float(w))).alias("score")) for p, w in parts]
    every = scaled[0]
    for p in scaled[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("user_id", "item_id").agg(score(F.sum("score")).alias("score"))
    return top_per_group(summed, "user_id", [F.desc("score"), F.asc("item_id")], top_n)
