"""Data-health checks of an interaction table; every check is one small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import share, whole_days

ORDER = ("ts", "row_key")


def counts(df: DataFrame) -> DataFrame:
    """n_users, n_items, n_interactions."""
    return df.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"),
                  F.count(F.lit(1)).alias("n_interactions"))


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each (user, item)."""
    cells = df.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def rating_histogram(df: DataFrame) -> DataFrame:
    """(rating, n, share)."""
    hist = df.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return hist.withColumn("share", share(F.col("n"), df.select(F.count(F.lit(1))).scalar()))


def sparsity(df: DataFrame) -> DataFrame:
    """sparsity, density and the severity level."""
    density = F.col("n_interactions") / (F.col("n_users") * F.col("n_items"))
    level = (F.when(F.col("sparsity") > 0.999, "CRITICAL").when(F.col("sparsity") > 0.99, "HIGH").otherwise("OK"))
    return counts(df).select((1 - density).alias("sparsity"), density.alias("density")).withColumn("severity", level)


def _sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _histogram(df: DataFrame, key: str) -> DataFrame:
    """(x, f): f keys have x rows. At most sqrt(2 * rows) lines, safe for a one-task window."""
    return _sizes(df, key).groupBy(F.col("n").alias("x")).agg(F.count(F.lit(1)).alias("f"))


def _both(df: DataFrame, check) -> DataFrame:
    """Run a per-side check for users and items; adds side."""
    sides = [check(df, key).withColumn("side", F.lit(name)) for key, name in (("user_id", "user"), ("item_id", "item"))]
    return sides[0].unionByName(sides[1])


def activity(df: DataFrame) -> DataFrame:
    """Per side: mean, median, min and max rows per key."""
    def one(d, key):
        h = _histogram(d, key)
        return h.agg((F.sum(F.col("x") * F.col("f")) / F.sum("f")).alias("mean_rows"),
                     F.percentile("x", F.lit(0.5), F.col("f")).alias("median_rows"),
                     F.min("x").alias("min_rows"), F.max("x").alias("max_rows"))
    return _both(df, one)


def few_rows(df: DataFrame, at_most: int = 2) -> DataFrame:
    """Per side: keys with at most ``at_most`` rows and their share."""
    def one(d, key):
        few = F.coalesce(F.sum(F.when(F.col("x") <= at_most, F.col("f"))), F.lit(0))
        return _histogram(d, key).agg(few.alias("n_few"), share(few, F.sum("f")).alias("few_share"))
    return _both(df, one)


def concentration(df: DataFrame, part: float = 0.01) -> DataFrame:
    """Per side: share of all rows held by the largest int(part * n) keys."""
    def one(d, key):
        h = _histogram(d, key)
        before = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy()
        ranked = h.select("x", "f", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("c"),
                          F.floor(F.sum("f").over(whole) * F.lit(float(part))).alias("m"))
        taken = F.least(F.col("f"), F.greatest(F.lit(0), F.col("m") - F.col("c")))
        return ranked.agg((F.sum(F.col("x") * taken) / F.sum(F.col("x") * F.col("f"))).alias("top_share"))
    return _both(df, one)


def gini(df: DataFrame) -> DataFrame:
    """Per side: Gini coefficient of rows per key, in closed form over the histogram."""
    def one(d, key):
        h = _histogram(d, key)
        before = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        ranked = h.select("x", "f", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("c"),
                          F.sum("f").over(Window.partitionBy()).alias("n"))
        f, n = F.col("f").cast("double"), F.col("n").cast("double")
        stairs = f * (n + 1) - f * F.col("c") - f * (f + 1) / 2
        return ranked.agg(F.sum(F.col("x") * stairs).alias("s"), F.sum(F.col("x") * f).alias("t"), F.max(n).alias("n")).select(
            ((F.col("n") + 1 - 2 * F.col("s") / F.col("t")) / F.col("n")).alias("gini"))
    return _both(df, one)


def _first_keys(df: DataFrame, key: str, n: int, order: tuple[str, ...]) -> DataFrame:
    """(key, ord): 1-based ordinal of the first n keys by first appearance; n rows."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_f")).orderBy("_f").limit(n)
    return first.withColumn("ord", F.row_number().over(Window.orderBy("_f"))).drop("_f")


def _ordinal_pairs(keys: DataFrame, heads: int, reach: int) -> DataFrame:
    """(a, b) ordinals with a <= heads and a < b <= a + reach, out of a frame of bounded size."""
    one = keys.filter(F.col("ord") <= heads).select(F.col("ord").alias("a"), F.explode(
        F.sequence(F.col("ord") + 1, F.col("ord") + reach)).alias("b"))
    return one.join(F.broadcast(keys.select(F.col("ord").alias("b"))), "b")


def user_overlap(df: DataFrame, heads: int = 100, reach: int = 50, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Mean item overlap and Jaccard of the first users with the next ones, in order of appearance."""
    users = _first_keys(df, "user_id", heads + reach, order)
    held = df.select("user_id", "item_id").join(F.broadcast(users), "user_id").select("ord", "item_id").distinct()
    sizes = held.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    near = F.col("b").between(F.col("a") + 1, F.col("a") + reach) & (F.col("a") <= heads)
    shared = (held.select(F.col("ord").alias("a"), "item_id").join(held.select(F.col("ord").alias("b"), "item_id"), "item_id")
              .filter(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("o")))
    pairs = (_ordinal_pairs(users, heads, reach).join(shared, ["a", "b"], "left").fillna(0, ["o"])
             .join(sizes.select(F.col("ord").alias("a"), F.col("n").alias("na")), "a")
             .join(sizes.select(F.col("ord").alias("b"), F.col("n").alias("nb")), "b"))
    return pairs.agg(F.avg("o").alias("mean_overlap"),
                     F.avg(F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("mean_jaccard"),
                     F.count(F.lit(1)).alias("n_pairs"))


def evaluation_coverage(df: DataFrame) -> DataFrame:
    """Users with at least two rows and their share."""
    multi = F.coalesce(F.sum(F.when(F.col("x") >= 2, F.col("f"))), F.lit(0))
    return _histogram(df, "user_id").agg(multi.alias("evaluatable"), share(multi, F.sum("f")).alias("evaluatable_share"))


def time_span(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(whole_days(F.max(ts) - F.min(ts)).alias("span_days"))


def similarity_potential(df: DataFrame, heads: int = 500, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Of the first items by appearance: how many have at least two distinct users."""
    items = _first_keys(df, "item_id", heads, order)
    users = df.select("item_id", "user_id").join(F.broadcast(items), "item_id").groupBy("ord").agg(
        F.count_distinct("user_id").alias("u"))
    multi = F.count_if(F.col("u") >= 2)
    return users.agg(multi.alias("comparable"), F.count(F.lit(1)).alias("n_sampled"),
                     share(multi, F.count(F.lit(1))).alias("comparable_share"))


def cooccurrence_rate(df: DataFrame, heads: int = 50, reach: int = 20, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Share of (first items, next items) pairs having a common user."""
    items = _first_keys(df, "item_id", heads + reach, order)
    held = df.select("item_id", "user_id").join(F.broadcast(items), "item_id").select("ord", "user_id").distinct()
    shared = (held.select(F.col("ord").alias("a"), "user_id").join(held.select(F.col("ord").alias("b"), "user_id"), "user_id")
              .filter(F.col("b").between(F.col("a") + 1, F.col("a") + reach) & (F.col("a") <= heads))
              .select("a", "b").distinct().withColumn("hit", F.lit(1)))
    pairs = _ordinal_pairs(items, heads, reach).join(shared, ["a", "b"], "left").fillna(0, ["hit"])
    return pairs.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("cooc_rate"), F.count(F.lit(1)).alias("n_pairs"))


def cold_start(df: DataFrame) -> DataFrame:
    """Per side: keys with a single row and their share."""
    return few_rows(df, 1).select("side", F.col("n_few").alias("n_cold"), F.col("few_share").alias("cold_share"))


def statistics(df: DataFrame) -> DataFrame:
    """All checks as one wide row; each is a scalar subquery, none depends on another."""
    def pick(check: DataFrame, column: str, side: str | None = None) -> Column:
        rows = check if side is None else check.filter(F.col("side") == side)
        return rows.select(column).scalar()

    few, top, unequal, cold = few_rows(df), concentration(df), gini(df), cold_start(df)
    spars, over, cov = sparsity(df), user_overlap(df), evaluation_coverage(df)
    five = rating_histogram(df).filter(F.col("rating") == 5.0).select("share").scalar()
    return counts(df).select(
        "n_users", "n_items", "n_interactions",
        pick(duplicates(df), "duplicates").alias("duplicates"), F.coalesce(five, F.lit(0.0)).alias("five_share"),
        pick(spars, "sparsity").alias("sparsity"), pick(spars, "density").alias("density"),
        *[pick(c, col, s).alias(f"{s}_{col}") for c, col in (
            (few, "few_share"), (top, "top_share"), (unequal, "gini"), (cold, "cold_share")) for s in ("user", "item")],
        pick(over, "mean_overlap").alias("mean_overlap"), pick(over, "mean_jaccard").alias("mean_jaccard"),
        pick(cov, "evaluatable_share").alias("evaluatable_share"), pick(time_span(df), "span_days").alias("span_days"),
        pick(similarity_potential(df), "comparable_share").alias("comparable_share"),
        pick(cooccurrence_rate(df), "cooc_rate").alias("cooc_rate"))


def _rules() -> list[tuple[Column, str, list[Column]]]:
    """(condition, text format, arguments) in check order. Texts and limits are fixed values."""
    def c(name: str) -> Column:
        return F.col(name)

    def pct(name: str) -> Column:
        return F.col(name) * 100

    return [
        (c("duplicates") > 0, "Found %d duplicate user-item interactions", [c("duplicates")]),
        (c("five_share") > 0.6, "High rating bias detected (>60%% ratings are 5.0)", []),
        (c("sparsity") > 0.999, "CRITICAL: Extreme sparsity (%.6f)", [c("sparsity")]),
        ((c("sparsity") > 0.99) & (c("sparsity") <= 0.999), "HIGH: Very high sparsity (%.6f)", [c("sparsity")]),
        (c("user_few_share") > 0.8, "Too many users with ≤2 interactions (%.1f%%)", [pct("user_few_share")]),
        (c("item_few_share") > 0.8, "Too many items with ≤2 interactions (%.1f%%)", [pct("item_few_share")]),
        (c("item_top_share") > 0.5, "Severe popularity bias: top 1%% items = %.1f%% interactions", [pct("item_top_share")]),
        (c("user_top_share") > 0.3, "High user activity concentration: top 1%% users = %.1f%% interactions", [pct("user_top_share")]),
        (c("user_gini") > 0.8, "Very unequal user distribution (Gini: %.3f)", [c("user_gini")]),
        (c("item_gini") > 0.8, "Very unequal item distribution (Gini: %.3f)", [c("item_gini")]),
        (c("mean_overlap") < 1.0, "Very low user-item overlap (avg: %.2f)", [c("mean_overlap")]),
        (c("mean_jaccard") < 0.01, "Extremely low user similarity potential (%.4f)", [c("mean_jaccard")]),
        (c("evaluatable_share") < 0.3, "Low evaluation coverage: only %.1f%% users evaluatable", [pct("evaluatable_share")]),
        (c("span_days") < 30, "Very short time span (%d days) - may lack temporal diversity", [c("span_days")]),
        (c("comparable_share") < 0.5, "Low similarity potential: only %.1f%% items have ≥2 users", [pct("comparable_share")]),
        (c("cooc_rate") < 0.1, "Very low item co-occurrence rate (%.3f)", [c("cooc_rate")]),
        (c("user_cold_share") > 0.5, "High cold-start user ratio: %.1f%%", [pct("user_cold_share")]),
        (c("item_cold_share") > 0.5, "High cold-start item ratio: %.1f%%", [pct("item_cold_share")]),
    ]


def issues(stats: DataFrame) -> DataFrame:
    """(pos, issue): the texts of all rules that fire on a statistics row, in check order."""
    found = [F.when(cond, F.struct(F.lit(i).alias("pos"), (F.format_string(text, *args) if args else F.lit(text.replace("%%", "%"))).alias("issue")))
             for i, (cond, text, args) in enumerate(_rules(), 1)]
    return stats.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_i")).select("_i.pos", "_i.issue")


# Words looked for in the issue texts, and the advice they lead to; the last field of each is
# the call of this library that follows the advice.
ADVICE = (
    (("sparsity",), "Data Filtering", "Increase minimum interaction thresholds",
     "Filter users with <5 interactions and items with <5 interactions",
     "cleaning.minimum_counts(df, 5, 5)"),
    (("overlap", "similarity"), "Similarity Computation", "Lower similarity thresholds and increase k",
     "Use min_similarity=0.001, k=50-100, try Jaccard for binary data",
     "recommend.Settings(similarity_method='jaccard', k=50, min_similarity=0.001)"),
    (("coverage", "evaluation"), "Evaluation Strategy", "Improve train/test split strategy",
     "Use temporal split or stratified sampling, require min 3 interactions for evaluation",
     "splits.temporal_split(df, 0.2, keep=3)"),
    (("popularity", "bias"), "Popularity Bias", "Add popularity-based regularization",
     "Penalize popular items in recommendations, boost long-tail items",
     "recommend.Settings(popularity_weight=0.1)"),
    (("cold",), "Cold Start Handling", "Implement hybrid approach",
     "Combine collaborative filtering with content-based and popularity-based methods",
     "plans.hybrid.recommend_hybrid(parts, train, users, 10)"),
)


def advice(found: DataFrame) -> DataFrame:
    """(pos, category, action, details, code): advice whose words occur in any issue text."""
    low = F.lower("issue")
    hit = found.agg(*[F.coalesce(F.max(F.greatest(*[low.contains(w) for w in words] + [F.lit(False)])), F.lit(False)).alias(f"a{i}")
                      for i, (words, *_) in enumerate(ADVICE, 1)])
    rows = [F.when(F.col(f"a{i}"), F.struct(F.lit(i).alias("pos"), F.lit(cat).alias("category"),
                                            F.lit(act).alias("action"), F.lit(det).alias("details"), F.lit(code).alias("code")))
            for i, (_, cat, act, det, code) in enumerate(ADVICE, 1)]
    return hit.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_a")).select("_a.*")


def report(stats: DataFrame) -> DataFrame:
    """(section, pos, key, value): statistics, issues and advice as text rows."""
    numbers = [("n_users", "%d"), ("n_items", "%d"), ("n_interactions", "%d"), ("sparsity", "%.6f"), ("density", "%.6f")]
    head = stats.select(F.explode(F.array(*[
        F.struct(F.lit("statistics").alias("section"), F.lit(i).alias("pos"), F.lit(n).alias("key"),
                 F.format_string(f, F.col(n)).alias("value")) for i, (n, f) in enumerate(numbers, 1)])).alias("_s")).select("_s.*")
    found = issues(stats)
    listed = found.select(F.lit("issue").alias("section"), "pos", F.lit("issue").alias("key"), F.col("issue").alias("value"))
    tips = advice(found).select(F.lit("advice").alias("section"), "pos", F.col("category").alias("key"),
                                F.concat_ws(": ", "action", "details").alias("value"))
    return head.unionByName(listed).unionByName(tips)


def save_report(report_rows: DataFrame, path: str) -> None:
    """Write the report (a few dozen rows) as text lines."""
    section = F.when(F.col("section") == "statistics", 1).when(F.col("section") == "issue", 2).otherwise(3)
    (report_rows.orderBy(section, "pos").select(F.concat_ws(" | ", "section", "key", "value").alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))
