"""Data-health checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..operators import diagnostics as dg
from ..session import durable
from ..sources.tables import interactions
from .sql import INTER


def _on(check, source=interactions):
    def run(spark, d):
        out = check(source(spark, d))
        return out.select(*[shown(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    return run


def _basket_stats(spark, d):
    """Orders as users: a sparse table on which many rules fire."""
    order = F.split("row_key", "\\|")[0].cast("bigint")
    return durable(dg.statistics(durable(interactions(spark, d).withColumn("user_id", order))))


QUERIES = {
    "diag_counts": _on(dg.counts),
    "diag_duplicates": _on(dg.duplicates),
    "diag_ratings": _on(dg.rating_histogram),
    "diag_sparsity": _on(dg.sparsity),
    "diag_activity": _on(dg.activity),
    "diag_few": _on(lambda df: dg.few_rows(df, 20)),
    "diag_concentration": _on(dg.concentration),
    "diag_gini": _on(dg.gini),
    "diag_user_overlap": _on(dg.user_overlap),
    "diag_eval_coverage": _on(dg.evaluation_coverage),
    "diag_time_span": _on(dg.time_span),
    "diag_sim_potential": _on(dg.similarity_potential),
    "diag_cooc_rate": _on(dg.cooccurrence_rate),
    "diag_cold": _on(dg.cold_start),
    "diag_issues": lambda s, d: dg.issues(_basket_stats(s, d)),
    "diag_advice": lambda s, d: dg.advice(dg.issues(_basket_stats(s, d))),
    "diag_report": lambda s, d: dg.report(_basket_stats(s, d)),
}


def _sides(sql: str) -> str:
    """The statement for users and for items; {k} is the key, {s} the side."""
    return " UNION ALL ".join(sql.format(k=k, s=s) for k, s in (("user_id", "user"), ("item_id", "item")))


def _first(src, key, n):
    return (f"SELECT {key}, row_number() OVER (ORDER BY f) AS ord FROM "
            f"(SELECT {key}, min(row(ts, row_key)) AS f FROM {src} GROUP BY 1) QUALIFY ord <= {n}")


def _overlap(src):
    return f"""fu AS ({_first(src, 'user_id', 150)}),
held AS (SELECT DISTINCT ord, item_id FROM {src} JOIN fu USING (user_id)),
hn AS (SELECT ord, count(*) AS n FROM held GROUP BY 1),
prs AS (SELECT a.ord AS a, b.ord AS b FROM fu a, fu b WHERE a.ord <= 100 AND b.ord > a.ord AND b.ord <= a.ord + 50),
ov AS (SELECT p.a, p.b, (SELECT count(*) FROM held x JOIN held y USING (item_id) WHERE x.ord = p.a AND y.ord = p.b) AS o FROM prs p),
overlap AS (SELECT avg(o) AS mo, avg(o / CAST(x.n + y.n - o AS DOUBLE)) AS mj, count(*) AS np
  FROM ov JOIN hn x ON x.ord = a JOIN hn y ON y.ord = b)"""


def _potential(src):
    return f"""fi AS ({_first(src, 'item_id', 500)}),
nu AS (SELECT ord, count(DISTINCT user_id) AS u FROM {src} JOIN fi USING (item_id) GROUP BY 1),
potential AS (SELECT count(*) FILTER (WHERE u >= 2) AS c, count(*) AS n,
  count(*) FILTER (WHERE u >= 2) / CAST(count(*) AS DOUBLE) AS sh FROM nu),
fc AS (SELECT * FROM fi WHERE ord <= 70),
hu AS (SELECT DISTINCT ord, user_id FROM {src} JOIN fc USING (item_id)),
cp AS (SELECT a.ord AS a, b.ord AS b, CASE WHEN EXISTS (SELECT 1 FROM hu x JOIN hu y USING (user_id) WHERE x.ord = a.ord AND y.ord = b.ord)
  THEN 1 ELSE 0 END AS hit FROM fc a, fc b WHERE a.ord <= 50 AND b.ord > a.ord AND b.ord <= a.ord + 20),
coocr AS (SELECT avg(hit) AS rate, count(*) AS n FROM cp)"""


def _gini(src, key):
    return f"""(SELECT (n + 1 - 2 * s / t) / n FROM (SELECT CAST(max(n) AS DOUBLE) AS n, sum((n - r + 1) * x) AS s, sum(x) AS t FROM
 (SELECT count(*) AS x, row_number() OVER (ORDER BY count(*)) AS r, count(*) OVER () AS n FROM {src} GROUP BY {key})))"""


def _top(src, key):
    return f"""(SELECT coalesce(sum(x) FILTER (WHERE r <= CAST(floor(n * CAST(0.01 AS DOUBLE)) AS BIGINT)), 0) / CAST(sum(x) AS DOUBLE) FROM
 (SELECT count(*) AS x, row_number() OVER (ORDER BY count(*) DESC) AS r, count(*) OVER () AS n FROM {src} GROUP BY {key}))"""


def _few(src, key, at_most):
    return f"(SELECT count(*) FILTER (WHERE x <= {at_most}) / CAST(count(*) AS DOUBLE) FROM (SELECT count(*) AS x FROM {src} GROUP BY {key}))"


def _r(expr):
    return f"round({expr} + 1e-10, 6)"


# The published issue and advice texts, their limits and their order.
_STATS = f"""WITH {INTER},
ev AS (SELECT CAST(split_part(row_key, '|', 1) AS BIGINT) AS user_id, item_id, rating, ts, row_key FROM inter),
{_overlap('ev')},
{_potential('ev')},
st AS (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_interactions,
  count(*) - count(DISTINCT (user_id, item_id)) AS dup, count(*) FILTER (WHERE rating = 5) / CAST(count(*) AS DOUBLE) AS five,
  count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT item_id)) AS density,
  CAST(floor((max(ts) - min(ts)) / 86400.0) AS BIGINT) AS span FROM ev),
w AS (SELECT *, 1 - density AS sparsity, {_few('ev', 'user_id', 2)} AS uf, {_few('ev', 'item_id', 2)} AS itf,
  {_top('ev', 'item_id')} AS it, {_top('ev', 'user_id')} AS ut, {_gini('ev', 'user_id')} AS ug, {_gini('ev', 'item_id')} AS ig,
  (SELECT mo FROM overlap) AS mo, (SELECT mj FROM overlap) AS mj, 1 - {_few('ev', 'user_id', 1)} AS cov,
  (SELECT sh FROM potential) AS sp, (SELECT rate FROM coocr) AS rate, {_few('ev', 'user_id', 1)} AS cu, {_few('ev', 'item_id', 1)} AS ci FROM st),
iss AS (
  SELECT 1 AS pos, printf('Found %d duplicate user-item interactions', dup) AS issue FROM w WHERE dup > 0
  UNION ALL SELECT 2, 'High rating bias detected (>60% ratings are 5.0)' FROM w WHERE five > 0.6
  UNION ALL SELECT 3, printf('CRITICAL: Extreme sparsity (%.6f)', sparsity) FROM w WHERE sparsity > 0.999
  UNION ALL SELECT 4, printf('HIGH: Very high sparsity (%.6f)', sparsity) FROM w WHERE sparsity > 0.99 AND sparsity <= 0.999
  UNION ALL SELECT 5, printf('Too many users with ≤2 interactions (%.1f%%)', uf * 100) FROM w WHERE uf > 0.8
  UNION ALL SELECT 6, printf('Too many items with ≤2 interactions (%.1f%%)', itf * 100) FROM w WHERE itf > 0.8
  UNION ALL SELECT 7, printf('Severe popularity bias: top 1%% items = %.1f%% interactions', it * 100) FROM w WHERE it > 0.5
  UNION ALL SELECT 8, printf('High user activity concentration: top 1%% users = %.1f%% interactions', ut * 100) FROM w WHERE ut > 0.3
  UNION ALL SELECT 9, printf('Very unequal user distribution (Gini: %.3f)', ug) FROM w WHERE ug > 0.8
  UNION ALL SELECT 10, printf('Very unequal item distribution (Gini: %.3f)', ig) FROM w WHERE ig > 0.8
  UNION ALL SELECT 11, printf('Very low user-item overlap (avg: %.2f)', mo) FROM w WHERE mo < 1.0
  UNION ALL SELECT 12, printf('Extremely low user similarity potential (%.4f)', mj) FROM w WHERE mj < 0.01
  UNION ALL SELECT 13, printf('Low evaluation coverage: only %.1f%% users evaluatable', cov * 100) FROM w WHERE cov < 0.3
  UNION ALL SELECT 14, printf('Very short time span (%d days) - may lack temporal diversity', span) FROM w WHERE span < 30
  UNION ALL SELECT 15, printf('Low similarity potential: only %.1f%% items have ≥2 users', sp * 100) FROM w WHERE sp < 0.5
  UNION ALL SELECT 16, printf('Very low item co-occurrence rate (%.3f)', rate) FROM w WHERE rate < 0.1
  UNION ALL SELECT 17, printf('High cold-start user ratio: %.1f%%', cu * 100) FROM w WHERE cu > 0.5
  UNION ALL SELECT 18, printf('High cold-start item ratio: %.1f%%', ci * 100) FROM w WHERE ci > 0.5),
rules AS (SELECT * FROM (VALUES
  (1, 'sparsity', 'sparsity', 'Data Filtering', 'Increase minimum interaction thresholds', 'Filter users with <5 interactions and items with <5 interactions',
   'cleaning.minimum_counts(df, 5, 5)'),
  (2, 'overlap', 'similarity', 'Similarity Computation', 'Lower similarity thresholds and increase k', 'Use min_similarity=0.001, k=50-100, try Jaccard for binary data',
   'recommend.Settings(similarity_method=''jaccard'', k=50, min_similarity=0.001)'),
  (3, 'coverage', 'evaluation', 'Evaluation Strategy', 'Improve train/test split strategy', 'Use temporal split or stratified sampling, require min 3 interactions for evaluation',
   'splits.temporal_split(df, 0.2, keep=3)'),
  (4, 'popularity', 'bias', 'Popularity Bias', 'Add popularity-based regularization', 'Penalize popular items in recommendations, boost long-tail items',
   'recommend.Settings(popularity_weight=0.1)'),
  (5, 'cold', 'cold', 'Cold Start Handling', 'Implement hybrid approach', 'Combine collaborative filtering with content-based and popularity-based methods',
   'plans.hybrid.recommend_hybrid(parts, train, users, 10)')
  ) t(pos, w1, w2, category, action, details, code)),
adv AS (SELECT pos, category, action, details, code FROM rules r
  WHERE EXISTS (SELECT 1 FROM iss WHERE contains(lower(issue), w1) OR contains(lower(issue), w2)))
"""

ORACLES = {
    "diag_counts": f"WITH {INTER} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_interactions FROM inter",
    "diag_duplicates": f"WITH {INTER} SELECT count(*) - count(DISTINCT (user_id, item_id)) AS duplicates FROM inter",
    "diag_ratings": f"WITH {INTER} SELECT rating, count(*) AS n, {_r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM inter GROUP BY 1",
    "diag_sparsity": f"""WITH {INTER},
d AS (SELECT count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT item_id)) AS d FROM inter)
SELECT {_r('1 - d')} AS sparsity, {_r('d')} AS density,
 CASE WHEN 1 - d > 0.999 THEN 'CRITICAL' WHEN 1 - d > 0.99 THEN 'HIGH' ELSE 'OK' END AS severity FROM d""",
    "diag_activity": f"WITH {INTER} " + _sides(
        "SELECT '{s}' AS side, round(avg(n) + 1e-10, 6) AS mean_rows, round(median(n) + 1e-10, 6) AS median_rows, min(n) AS min_rows, "
        "max(n) AS max_rows FROM (SELECT count(*) AS n FROM inter GROUP BY {k})"),
    "diag_few": f"WITH {INTER} " + _sides(
        "SELECT '{s}' AS side, count(*) FILTER (WHERE n <= 20) AS n_few, round(count(*) FILTER (WHERE n <= 20) / CAST(count(*) AS DOUBLE) "
        "+ 1e-10, 6) AS few_share FROM (SELECT count(*) AS n FROM inter GROUP BY {k})"),
    "diag_concentration": f"""WITH {INTER} SELECT 'user' AS side, {_r(_top('inter', 'user_id'))} AS top_share
UNION ALL SELECT 'item', {_r(_top('inter', 'item_id'))}""",
    "diag_gini": f"""WITH {INTER} SELECT 'user' AS side, {_r(_gini('inter', 'user_id'))} AS gini
UNION ALL SELECT 'item', {_r(_gini('inter', 'item_id'))}""",
    "diag_user_overlap": f"WITH {INTER},\n{_overlap('inter')}\nSELECT {_r('mo')} AS mean_overlap, {_r('mj')} AS mean_jaccard, np AS n_pairs FROM overlap",
    "diag_eval_coverage": f"""WITH {INTER} SELECT count(*) FILTER (WHERE n >= 2) AS evaluatable,
 {_r('count(*) FILTER (WHERE n >= 2) / CAST(count(*) AS DOUBLE)')} AS evaluatable_share FROM (SELECT count(*) AS n FROM inter GROUP BY user_id)""",
    "diag_time_span": f"WITH {INTER} SELECT (max(ts) - min(ts)) // 86400 AS span_days FROM inter",
    "diag_sim_potential": f"WITH {INTER},\n{_potential('inter')}\nSELECT c AS comparable, n AS n_sampled, {_r('sh')} AS comparable_share FROM potential",
    "diag_cooc_rate": f"WITH {INTER},\n{_potential('inter')}\nSELECT {_r('rate')} AS cooc_rate, n AS n_pairs FROM coocr",
    "diag_cold": f"WITH {INTER} " + _sides(
        "SELECT '{s}' AS side, count(*) FILTER (WHERE n <= 1) AS n_cold, round(count(*) FILTER (WHERE n <= 1) / CAST(count(*) AS DOUBLE) "
        "+ 1e-10, 6) AS cold_share FROM (SELECT count(*) AS n FROM inter GROUP BY {k})"),
    "diag_issues": f"{_STATS} SELECT pos, issue FROM iss",
    "diag_advice": f"{_STATS} SELECT pos, category, action, details, code FROM adv",
    "diag_report": f"""{_STATS}
SELECT 'statistics' AS section, 1 AS pos, 'n_users' AS key, printf('%d', n_users) AS value FROM w
UNION ALL SELECT 'statistics', 2, 'n_items', printf('%d', n_items) FROM w
UNION ALL SELECT 'statistics', 3, 'n_interactions', printf('%d', n_interactions) FROM w
UNION ALL SELECT 'statistics', 4, 'sparsity', printf('%.6f', sparsity) FROM w
UNION ALL SELECT 'statistics', 5, 'density', printf('%.6f', density) FROM w
UNION ALL SELECT 'issue', pos, 'issue', issue FROM iss
UNION ALL SELECT 'advice', pos, category, action || ': ' || details FROM adv""",
}
