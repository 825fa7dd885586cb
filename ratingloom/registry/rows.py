"""Cleaning, sampling, splits, encoding and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..operators import cleaning, splits, weights
from ..sources.tables import event_interactions, interactions, review_rows
from .sql import EVENTS, INTER, REVIEWS, decay, key_long, train_test

ORDER = ["ts", "row_key"]


def _flawed(spark, d):
    """Interactions whose ids are partly null, empty or the loader's placeholder."""
    df = interactions(spark, d)
    user = (F.when(F.col("ts") % 7 == 0, F.lit(None)).when(F.col("item_id") % 11 == 0, F.lit(""))
            .when(F.col("user_id") % 13 == 0, F.lit("unknown")).otherwise(F.col("user_id").cast("string")))
    return df.withColumn("user_id", user).withColumn("item_id", F.col("item_id").cast("string"))


FLAWED = INTER + """,
flawed AS (
  SELECT CASE WHEN ts % 7 = 0 THEN NULL WHEN item_id % 11 = 0 THEN ''
              WHEN user_id % 13 = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CAST(item_id AS VARCHAR) AS item_id, rating, ts, row_key FROM inter)"""


def _core_sql(rounds: int, head: str, cut) -> str:
    """Unrolled filter rounds r0 -> r1 -> ..; cut(source, key) gives the threshold."""
    out = [head]
    for i in range(rounds):
        src = f"r{i}"
        out.append(f"""u{i} AS (SELECT user_id, count(*) AS n FROM {src} GROUP BY 1),
i{i} AS (SELECT item_id, count(*) AS n FROM {src} GROUP BY 1),
r{i + 1} AS (SELECT * FROM {src} WHERE user_id IN (SELECT user_id FROM u{i} WHERE n >= {cut(f'u{i}')})
  AND item_id IN (SELECT item_id FROM i{i} WHERE n >= {cut(f'i{i}')}))""")
    return ",\n".join(out)


def _kcore_p5(spark, d):
    return cleaning.preserving_core(interactions(spark, d), min_user=20, min_item=20, preserve=0.5)


def _kcore_p10(spark, d):
    return cleaning.adaptive_core(interactions(spark, d), min_interactions=25)


def _cols(df, *names):
    return df.select(*names)


def _hybrid_weight(spark, d):
    rows = weights.with_expertise(review_rows(spark, d))
    return rows.select("row_key", shown(weights.signal_weight(rows)).alias("w"))


def _hybrid_matrix(spark, d):
    rows = weights.with_expertise(review_rows(spark, d))
    cells = weights.activity_normalised(rows.withColumn("w", weights.signal_weight(rows)))
    return cells.select("user_id", "item_id", shown("w").alias("w"))


def _cells(spark, d):
    return weights.user_item_cells(weights.interaction_weight(interactions(spark, d)))


def _sample_stratified(spark, d):
    df = event_interactions(spark, d).select("user_id", "item_id", "ts", "row_key")
    return cleaning.stratified_sample(df, 5000, active_rows=70)


EXPERT = REVIEWS + """,
helped AS (SELECT *, CASE WHEN votes > 0 THEN CAST(ups AS DOUBLE) / votes ELSE 0.5 END AS helpfulness FROM reviews),
expert AS (SELECT *, avg(helpfulness) OVER (PARTITION BY user_id) AS user_expertise FROM helped)"""

SIGNAL = """(rating / 5.0) * sqrt(1 + 0.5 * CAST(ts - (SELECT min(ts) FROM expert) AS DOUBLE)
   / ((SELECT max(ts) FROM expert) - (SELECT min(ts) FROM expert) + 1))
   * (1 + CAST(0.3 AS DOUBLE) * helpfulness) * (1 + CAST(0.2 AS DOUBLE) * CAST(verified AS INTEGER))
   * (1 + CAST(0.2 AS DOUBLE) * user_expertise)"""

WEIGHTED = INTER + f""",
weighted AS (SELECT *, {decay('ts', 'inter', 0.95)} AS w FROM inter),
cells AS (SELECT user_id, item_id, sum(w) AS w, count(*) AS n FROM weighted GROUP BY 1, 2)"""

QUERIES = {
    "clean_ids": lambda s, d: cleaning.drop_blank_ids(_flawed(s, d)),
    "clean_unknown": lambda s, d: cleaning.drop_unknown_ids(_flawed(s, d)),
    "kcore_p10": _kcore_p10,
    "kcore_p5": _kcore_p5,
    "min_counts": lambda s, d: cleaning.minimum_counts(interactions(s, d), 35, 30),
    "min_user_window": lambda s, d: cleaning.minimum_user_rows(interactions(s, d), 40),
    "sample_n": lambda s, d: cleaning.sample_rows(interactions(s, d), 2500),
    "sample_stratified": _sample_stratified,
    "first_n_users": lambda s, d: cleaning.first_users(interactions(s, d), 100, ORDER),
    "split_stratified": lambda s, d: splits.flag_stratified(interactions(s, d)).select("user_id", "item_id", "row_key", "is_test"),
    "split_shuffled": lambda s, d: splits.flag_shuffled(interactions(s, d)).select("user_id", "item_id", "row_key", "is_test"),
    "split_temporal": lambda s, d: (lambda tr, te: tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test"))))(
        *splits.temporal_split(interactions(s, d))).select("user_id", "item_id", "row_key", "part"),
    "split_kfold": lambda s, d: splits.contiguous_folds(interactions(s, d).select("ts", "row_key"), ORDER).select("row_key", "fold"),
    "split_allbut": lambda s, d: splits.all_but_n(interactions(s, d), 11, 20, 1200).select("row_key", "is_test"),
    "cv_folds": lambda s, d: splits.hashed_folds(interactions(s, d)).select("row_key", "fold"),
    "encode_sorted": lambda s, d: weights.encode_sorted(interactions(s, d), "item_id"),
    "encode_first_seen": lambda s, d: weights.encode_first_seen(interactions(s, d), "user_id", ORDER),
    "time_decay": lambda s, d: weights.time_decay(interactions(s, d)).select("row_key", shown("decay").alias("decay")),
    "ui_matrix": lambda s, d: _cells(s, d).select("user_id", "item_id", shown("w").alias("w"), "n"),
    "ui_density": lambda s, d: weights.matrix_shape(_cells(s, d)).withColumn("density", shown("density")),
    "item_idf": lambda s, d: weights.item_idf(_cells(s, d)).withColumn("idf", shown("idf")),
    "user_profiles": lambda s, d: weights.user_profiles(interactions(s, d)).withColumn("avg_rating", shown("avg_rating")),
    "user_history": lambda s, d: weights.user_history(interactions(s, d)),
    "helpfulness": lambda s, d: review_rows(s, d).select(
        "row_key", shown(weights.helpfulness(F.col("helpful"))).alias("helpfulness")),
    "user_expertise": lambda s, d: weights.with_expertise(review_rows(s, d)).select(
        "row_key", shown("user_expertise").alias("user_expertise")),
    "hybrid_weight": _hybrid_weight,
    "hybrid_matrix": _hybrid_matrix,
}

_SHUFFLED = INTER + """,
keyed AS (SELECT user_id, item_id, row_key, md5('42|' || row_key) AS h FROM inter),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, row_key) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS cnt FROM keyed)"""

ORACLES = {
    "clean_ids": f"WITH {FLAWED} SELECT * FROM flawed WHERE user_id <> '' AND item_id <> ''",
    "clean_unknown": f"WITH {FLAWED} SELECT * FROM flawed WHERE user_id <> 'unknown' AND item_id <> 'unknown'",
    "kcore_p10": "WITH " + _core_sql(
        3, INTER + ",\nr0 AS (SELECT * FROM inter)",
        lambda t: f"(SELECT greatest(1, least(25, quantile_cont(n, 0.1))) FROM {t})") + " SELECT * FROM r3",
    "kcore_p5": "WITH " + _core_sql(
        3, INTER + ",\nr0 AS (SELECT * FROM inter)",
        lambda t: f"(SELECT greatest(20, CAST(floor(quantile_cont(n, 0.05)) AS BIGINT)) FROM {t})")
        + """ SELECT * EXCLUDE (stage) FROM (SELECT *, 1 AS stage FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)
 WHERE stage = (SELECT CASE WHEN (SELECT count(*) FROM r1) < floor(0.5 * (SELECT count(*) FROM r0)) THEN 1
                            WHEN (SELECT count(*) FROM r2) < floor(0.5 * (SELECT count(*) FROM r0)) THEN 2 ELSE 3 END)""",
    "min_counts": f"""WITH {INTER} SELECT * FROM inter
 WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 35)
   AND item_id IN (SELECT item_id FROM inter GROUP BY 1 HAVING count(*) >= 30)""",
    "min_user_window": f"""WITH {INTER} SELECT * EXCLUDE (c) FROM
 (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM inter) WHERE c >= 40""",
    "sample_n": f"WITH {INTER} SELECT * FROM inter ORDER BY md5('42|' || row_key), row_key LIMIT 2500",
    "sample_stratified": f"""WITH {EVENTS},
act AS (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) >= 70),
tagged AS (SELECT user_id, item_id, ts, row_key, md5('42|' || row_key) AS h,
                  user_id IN (SELECT user_id FROM act) AS active FROM ev),
ord AS (SELECT *, row_number() OVER (PARTITION BY active ORDER BY h, row_key) AS rn FROM tagged),
lim AS (SELECT least((SELECT count(*) FROM tagged WHERE active), CAST(floor(5000 * CAST(0.7 AS DOUBLE)) AS BIGINT)) AS na,
               (SELECT count(*) FROM tagged) AS total)
SELECT user_id, item_id, ts, row_key FROM ord, lim
WHERE total <= 5000 OR (active AND rn <= na) OR (NOT active AND rn <= 5000 - na)""",
    "first_n_users": f"""WITH {INTER},
firsts AS (SELECT user_id, min(row(ts, row_key)) AS f FROM inter GROUP BY 1)
SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM firsts ORDER BY f LIMIT 100)""",
    "split_stratified": f"WITH {INTER}, {train_test()} SELECT user_id, item_id, row_key, is_test FROM flagged",
    "split_shuffled": f"""WITH {_SHUFFLED}
SELECT user_id, item_id, row_key, cnt >= 3 AND rn > cnt - greatest(1, least(CAST(floor(cnt * CAST(0.2 AS DOUBLE)) AS BIGINT), cnt - 2)) AS is_test
FROM ranked""",
    "split_temporal": f"""WITH {INTER},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS cnt FROM inter),
parts AS (SELECT *, CASE WHEN rn > cnt - greatest(1, least(CAST(floor(cnt * CAST(0.2 AS DOUBLE)) AS BIGINT), cnt - 3))
                         THEN 'test' ELSE 'train' END AS part FROM ranked WHERE cnt >= 5),
known AS (SELECT item_id FROM parts WHERE part = 'train' GROUP BY item_id)
SELECT user_id, parts.item_id AS item_id, row_key, part FROM parts JOIN known ON known.item_id = parts.item_id""",
    "split_kfold": f"""WITH {INTER},
pos AS (SELECT row_key, row_number() OVER (ORDER BY ts, row_key) - 1 AS p, count(*) OVER () AS c FROM inter)
SELECT row_key, CAST(least(p // greatest(1, c // 5), 4) AS INTEGER) AS fold FROM pos""",
    "split_allbut": f"""WITH {INTER},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) BETWEEN 11 AND 20 AS want FROM inter),
capped AS (SELECT row_key, want, row_number() OVER (PARTITION BY want ORDER BY ts, row_key) AS t FROM ranked)
SELECT row_key, want AND t <= 1200 AS is_test FROM capped""",
    "cv_folds": f"""WITH {INTER}
SELECT row_key, CAST({key_long("md5('42|' || row_key)")} % 3 AS INTEGER) AS fold FROM inter""",
    "encode_sorted": f"""WITH {INTER}
SELECT DISTINCT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS idx FROM inter""",
    "encode_first_seen": f"""WITH {INTER},
firsts AS (SELECT user_id, min(row(ts, row_key)) AS f FROM inter GROUP BY 1)
SELECT user_id, row_number() OVER (ORDER BY f) - 1 AS idx FROM firsts""",
    "time_decay": f"WITH {WEIGHTED} SELECT row_key, round(w + 1e-10, 6) AS decay FROM weighted",
    "ui_matrix": f"WITH {WEIGHTED} SELECT user_id, item_id, round(w + 1e-10, 6) AS w, n FROM cells",
    "ui_density": f"""WITH {WEIGHTED}
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS nnz,
       round(count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT item_id)) + 1e-10, 6) AS density FROM cells""",
    "item_idf": f"""WITH {WEIGHTED}
SELECT item_id, count(DISTINCT user_id) AS n_holders,
       round(ln(CAST((SELECT count(DISTINCT user_id) FROM cells) AS DOUBLE) / (1 + count(DISTINCT user_id))), 6) AS idf
FROM cells WHERE w > 0 GROUP BY 1""",
    "user_profiles": f"""WITH {INTER}
SELECT user_id, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, min(ts) AS first_ts, max(ts) AS last_ts,
       round(avg(rating) + 1e-10, 6) AS avg_rating FROM inter GROUP BY 1""",
    "user_history": f"""WITH {INTER}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) AS pos, item_id, ts,
       row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, row_key) = 1 AS is_first FROM inter""",
    "helpfulness": f"WITH {EXPERT} SELECT row_key, round(helpfulness + 1e-10, 6) AS helpfulness FROM expert",
    "user_expertise": f"WITH {EXPERT} SELECT row_key, round(user_expertise + 1e-10, 6) AS user_expertise FROM expert",
    "hybrid_weight": f"WITH {EXPERT} SELECT row_key, round({SIGNAL} + 1e-10, 6) AS w FROM expert",
    "hybrid_matrix": f"""WITH {EXPERT},
sig AS (SELECT user_id, item_id, {SIGNAL} AS w FROM expert),
cell AS (SELECT user_id, item_id, sum(w) AS w FROM sig GROUP BY 1, 2)
SELECT user_id, item_id, round(w / sum(w) OVER (PARTITION BY user_id) + 1e-10, 6) AS w FROM cell""",
}
