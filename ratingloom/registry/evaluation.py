"""Evaluation of recommendation lists, sweeps and the ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..operators import ranking_metrics as rm
from ..operators import recommend as rec
from ..operators.splits import contiguous_folds, temporal_split
from ..plans import item_based as ib
from ..session import durable
from ..sources.tables import interactions
from .collab import train_and_test
from .collab_sql import candidates_sql, finish_sql, history_sql, model_sql, recommend_sql
from .sql import INTER, train_test


def _lists(spark, d, top_n=10):
    """Recommendations of the default model, written once, with train and test."""
    train, test = train_and_test(spark, d)
    return durable(rec.recommend(rec.fit(train), train, top_n)), train, test


def _eval_hits(spark, d):
    recs, _, test = _lists(spark, d)
    return rm.flag_hits(recs, test).select("user_id", "item_id", "rank", "hit")


def _eval_cf(spark, d):
    train, test = train_and_test(spark, d)
    return ib.evaluate_model(rec.fit(train), train, test).withColumn("value", shown("value"))


def _metric_summary(spark, d):
    train, test = train_and_test(spark, d)
    out = rm.summary(ib.evaluate_model(rec.fit(train), train, test))
    return out.select("metric", shown("mean_value").alias("mean_value"), "reached", shown("factor_needed").alias("factor_needed"))


def _on_lists(fn, *cols):
    def run(spark, d):
        recs, train, test = _lists(spark, d)
        out = fn(recs, test, train)
        return out.select(*[shown(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    return run


def _eval_ensemble(spark, d):
    train, test = train_and_test(spark, d)
    return ib.evaluate_ensemble(train, test).withColumn("value", shown("value"))


def _recommend_ensemble(spark, d):
    train, test = train_and_test(spark, d)
    return ib.ensemble(train, test).select("user_id", "item_id", shown("score").alias("score"), "rank")


def _sweep(settings):
    def run(spark, d):
        train, test = train_and_test(spark, d)
        return ib.sweep(train, test, list(settings)).withColumn("value", shown("value"))
    return run


def _split_stats(spark, d):
    train, test = temporal_split(interactions(spark, d))
    out = rm.split_stats(durable(train), durable(test), 10)
    return out.select(*[shown(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _rating_error(spark, d):
    """Item-mean predictor of the last contiguous fold, trained on the other four."""
    folds = durable(contiguous_folds(interactions(spark, d), ["ts", "row_key"]))
    means = folds.filter("fold < 4").groupBy("item_id").agg(F.avg("rating").alias("estimate"))
    out = rm.rating_error(folds.filter("fold = 4").join(means, "item_id"))
    return out.select(shown("rmse").alias("rmse"), shown("mae").alias("mae"), "n")


def _sample_recs(spark, d):
    train, test = train_and_test(spark, d)
    out = ib.sample_recommendations(rec.fit(train), train, test)
    return out.select("user_id", "item_id", shown("score").alias("score"), "rank")


QUERIES = {
    "eval_hits": _eval_hits,
    "eval_cf": _eval_cf,
    "metric_summary": _metric_summary,
    "recommend_ensemble": _recommend_ensemble,
    "eval_ensemble": _eval_ensemble,
    "eval_hybrid": _on_lists(rm.evaluate_hybrid),
    "eval_cold_users": _on_lists(lambda r, te, tr: rm.evaluate_cold_users(r, te, tr, 10, 25).drop("time_to_first_good")),
    "eval_time_to_good": _on_lists(lambda r, te, tr: rm.evaluate_cold_users(r, te, tr, 10, 25).select("time_to_first_good")),
    "eval_cold_items": _on_lists(lambda r, te, tr: rm.evaluate_cold_items(r, te, tr, 10, 25)),
    "eval_novelty": _on_lists(rm.evaluate_novelty),
    "sweep_cf": _sweep(ib.SECOND_SWEEP),
    "sweep_first": _sweep(ib.FIRST_SWEEP),
    "split_stats": _split_stats,
    "rating_error": _rating_error,
    "sample_recs": _sample_recs,
}

_TRAIN = f"WITH {INTER},\n{train_test()}"
_BASE = f"{_TRAIN},\n{model_sql('m', 'train')},\n{recommend_sql('m', 'train')}"


def hits_sql(out: str, k: int, recs: str | None = None) -> str:
    """CTEs flag_<out> and user_<out> (per-user metrics) of recs_<out> against test."""
    return f"""flag_{out} AS (
  SELECT r.user_id, r.item_id, r.rank, nt.n_test,
         CASE WHEN EXISTS (SELECT 1 FROM test t WHERE t.user_id = r.user_id AND t.item_id = r.item_id) THEN 1 ELSE 0 END AS hit
  FROM {recs or 'recs_' + out} r JOIN (SELECT user_id, count(DISTINCT item_id) AS n_test FROM test GROUP BY 1) nt
    ON nt.user_id = r.user_id WHERE r.rank <= {k}),
run_{out} AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) / CAST(rank AS DOUBLE) AS prec_at FROM flag_{out}),
user_{out} AS (
  SELECT user_id, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS listed, max(n_test) AS n_test,
         sum(hit / log2(rank + 1)) AS dcg, min(rank) FILTER (WHERE hit = 1) AS first, sum(hit * prec_at) AS ap,
         sum(hit) / CAST({k} AS DOUBLE) AS pk, sum(hit) / CAST(count(*) AS DOUBLE) AS p, sum(hit) / CAST(max(n_test) AS DOUBLE) AS r
  FROM run_{out} GROUP BY 1),
gain AS (SELECT i AS n, sum(1 / log2(i + 1)) OVER (ORDER BY i) AS g FROM range(1, 101) t(i))""".replace(
        "gain AS", f"gain_{out} AS")


def lists_sql(out: str, k: int, tag: str) -> str:
    """SELECT of the item-based metrics of one k."""
    return f"""SELECT {k} AS k, unnest(['Precision', 'Recall', 'F1', 'NDCG', 'MAP', 'MRR', 'HitRate', 'Coverage', 'Users_Evaluated']) AS metric,
 unnest([coalesce(avg(p) FILTER (WHERE hits > 0), 0), coalesce(avg(r) FILTER (WHERE hits > 0), 0),
  coalesce(avg(2 * p * r / (p + r)) FILTER (WHERE hits > 0), 0),
  coalesce(avg(dcg / g) FILTER (WHERE hits > 0), 0), coalesce(avg(ap / hits) FILTER (WHERE hits > 0), 0),
  coalesce(avg(1.0 / first) FILTER (WHERE hits > 0), 0), count(*) FILTER (WHERE hits > 0) / CAST(count(*) AS DOUBLE),
  (SELECT count(DISTINCT item_id) FROM flag_{out}) / CAST((SELECT count(DISTINCT item_id) FROM cells_{tag}) AS DOUBLE),
  CAST(count(*) AS DOUBLE)]) AS value
 FROM user_{out} JOIN gain_{out} ON n = least(n_test, {k})"""


def eval_cf_sql(tag: str, ks, popw=0.2) -> tuple[str, str]:
    """(CTEs, union of selects) of one fitted tag."""
    ctes, sel = [], []
    for k in ks:
        out = f"{tag}{k}"
        ctes.append(finish_sql(tag, k, popw, out=out))
        ctes.append(hits_sql(out, k))
        sel.append(lists_sql(out, k, tag))
    return ",\n".join(ctes), "\nUNION ALL ".join(sel)


_EVAL = eval_cf_sql("m", (5, 10, 20))
_EVAL_HEAD = f"{_TRAIN},\n{model_sql('m', 'train')},\n{history_sql('m', 'train', 0.95)},\n{candidates_sql('m')},\n{_EVAL[0]}"


def _tag_sql(tag, s: rec.Settings):
    return ",\n".join([model_sql(tag, "train", s.similarity_method, s.k, s.min_similarity, s.time_decay_factor, s.use_idf_weighting),
                       history_sql(tag, "train", s.time_decay_factor), candidates_sql(tag)])


def _ensemble_sql():
    parts, union = [], []
    for i, (s, w) in enumerate(ib.ENSEMBLE):
        parts += [_tag_sql(f"e{i}", s), finish_sql(f"e{i}", 20, s.popularity_weight)]
        union.append(f"SELECT user_id, item_id, score * CAST({w} AS DOUBLE) AS score FROM recs_e{i}")
    parts.append(f"""summed AS (SELECT user_id, item_id, round(sum(score), 9) AS score FROM ({' UNION ALL '.join(union)})
  WHERE user_id IN (SELECT user_id FROM test) GROUP BY 1, 2),
recs_ens AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM summed QUALIFY rank <= 10)""")
    return f"{_TRAIN},\n" + ",\n".join(parts)


def _sweep_sql(settings):
    parts, sels = [], []
    for i, s in enumerate(settings):
        tag = f"s{i}"
        ctes, sel = eval_cf_sql(tag, (5, 10, 20), s.popularity_weight)
        parts += [_tag_sql(tag, s), ctes]
        sels.append(f"SELECT {i} AS i, '{s.name}' AS config, * FROM ({sel})")
    return f"""{_TRAIN},
{(",\n").join(parts)},
swept AS ({" UNION ALL ".join(sels)}),
win AS (SELECT i FROM (SELECT i, round(avg(value), 9) AS f FROM swept WHERE metric = 'F1' GROUP BY 1) ORDER BY f DESC, i LIMIT 1)
SELECT config, k, metric, round(value + 1e-10, 6) AS value, i = (SELECT i FROM win) AS best FROM swept"""


ORACLES = {
    "eval_hits": f"{_BASE},\n{hits_sql('m', 10)}\nSELECT user_id, item_id, rank, hit FROM flag_m",
    "eval_cf": f"{_EVAL_HEAD}\nSELECT k, metric, round(value + 1e-10, 6) AS value FROM ({_EVAL[1]})",
    "metric_summary": f"""{_EVAL_HEAD},
means AS (SELECT metric, avg(value) AS m FROM ({_EVAL[1]}) WHERE metric IN ('Precision', 'Recall', 'F1', 'NDCG', 'HitRate') GROUP BY 1)
SELECT metric, round(m + 1e-10, 6) AS mean_value, (metric = 'F1' AND m >= 0.05) AS reached,
       CASE WHEN metric = 'F1' AND m > 0 AND m < 0.05 THEN round(0.05 / m + 1e-10, 6) END AS factor_needed FROM means""",
    "recommend_ensemble": f"{_ensemble_sql()}\nSELECT user_id, item_id, round(score + 1e-10, 6) AS score, rank FROM recs_ens",
    "eval_ensemble": f"""{_ensemble_sql()},
{hits_sql('ens', 10)}
SELECT unnest(['Precision', 'Recall', 'F1', 'HitRate', 'Users_Evaluated']) AS metric,
 unnest([round(coalesce(avg(p) FILTER (WHERE hits > 0), 0) + 1e-10, 6), round(coalesce(avg(r) FILTER (WHERE hits > 0), 0) + 1e-10, 6),
  round(coalesce(avg(2 * p * r / (p + r)) FILTER (WHERE hits > 0), 0) + 1e-10, 6),
  round(count(*) FILTER (WHERE hits > 0) / CAST(count(*) AS DOUBLE) + 1e-10, 6), round(count(*) + 1e-10, 6)]) AS value FROM user_ens""",
    "eval_hybrid": f"""{_BASE},
{hits_sql('m', 10)},
means AS (SELECT avg(pk) AS p, avg(r) AS r, avg(CASE WHEN hits > 0 THEN dcg / g ELSE 0 END) AS ndcg,
   avg(CASE WHEN hits > 0 THEN ap / hits ELSE 0 END) AS ap, avg(CASE WHEN hits > 0 THEN 1.0 / first ELSE 0 END) AS mrr,
   count(*) FILTER (WHERE hits > 0) / CAST(count(*) AS DOUBLE) AS hr
 FROM user_m LEFT JOIN gain_m ON n = least(hits, 10))
SELECT unnest(['Precision', 'Recall', 'NDCG', 'MAP', 'MRR', 'HitRate', 'F1', 'Coverage']) AS metric,
 unnest([round(p + 1e-10, 6), round(r + 1e-10, 6), round(ndcg + 1e-10, 6), round(ap + 1e-10, 6), round(mrr + 1e-10, 6), round(hr + 1e-10, 6),
  round(2 * p * r / (p + r + 1e-8) + 1e-10, 6),
  round((SELECT count(DISTINCT item_id) FROM flag_m) / CAST((SELECT count(DISTINCT item_id) FROM train) AS DOUBLE) + 1e-10, 6)]) AS value
FROM means""",
    "eval_cold_users": f"""{_BASE},
{hits_sql('m', 10)},
cold AS (SELECT u.*, c.n FROM user_m u JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY 1 HAVING count(*) <= 25) c USING (user_id))
SELECT count(*) AS cold_users, round(coalesce(avg(pk), 0) + 1e-10, 6) AS cold_user_precision,
       round(coalesce(count(*) FILTER (WHERE hits > 0) / CAST(nullif(count(*), 0) AS DOUBLE), 0) + 1e-10, 6) AS cold_user_hit_rate FROM cold""",
    "eval_time_to_good": f"""{_BASE},
{hits_sql('m', 10)},
cold AS (SELECT u.*, c.n FROM user_m u JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY 1 HAVING count(*) <= 25) c USING (user_id))
SELECT round(coalesce(avg(n) FILTER (WHERE hits > 0), 0) + 1e-10, 6) AS time_to_first_good FROM cold""",
    "eval_cold_items": f"""{_BASE},
{hits_sql('m', 10)},
cold AS (SELECT user_id, count(*) / CAST(10 AS DOUBLE) AS p FROM flag_m
  WHERE hit = 1 AND item_id IN (SELECT item_id FROM train GROUP BY 1 HAVING count(*) <= 25) GROUP BY 1)
SELECT count(*) AS users, round(coalesce(avg(p), 0) + 1e-10, 6) AS cold_item_precision FROM cold""",
    "eval_novelty": f"""{_BASE},
{hits_sql('m', 10)},
pop AS (SELECT item_id, count(*) AS c FROM train GROUP BY 1),
nov AS (SELECT user_id, avg(-log2(coalesce(c, 1) / CAST((SELECT count(*) FROM train) AS DOUBLE))) AS v
  FROM flag_m LEFT JOIN pop USING (item_id) GROUP BY 1)
SELECT round(avg(v) + 1e-10, 6) AS novelty FROM nov""",
    "sweep_cf": _sweep_sql(ib.SECOND_SWEEP),
    "sweep_first": _sweep_sql(ib.FIRST_SWEEP),
    "split_stats": f"""WITH {INTER},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS cnt FROM inter),
parts AS (SELECT *, rn > cnt - greatest(1, least(CAST(floor(cnt * CAST(0.2 AS DOUBLE)) AS BIGINT), cnt - 3)) AS is_test
  FROM ranked WHERE cnt >= 5),
tr AS (SELECT * FROM parts WHERE NOT is_test),
te AS (SELECT * FROM parts WHERE is_test AND item_id IN (SELECT item_id FROM tr)),
cu AS (SELECT user_id, count(*) AS n FROM tr GROUP BY 1), ci AS (SELECT item_id, count(*) AS n FROM tr GROUP BY 1)
SELECT count(*) AS train_rows, count(DISTINCT user_id) AS train_users, count(DISTINCT item_id) AS train_items,
 (SELECT count(*) FROM te) AS test_rows, (SELECT count(DISTINCT user_id) FROM te) AS test_users,
 round((SELECT count(*) FROM te) / CAST(count(*) + (SELECT count(*) FROM te) AS DOUBLE) + 1e-10, 6) AS test_share,
 round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE) + 1e-10, 6) AS rows_per_user,
 round(count(*) / CAST(count(DISTINCT item_id) AS DOUBLE) + 1e-10, 6) AS rows_per_item,
 round((SELECT count(*) FILTER (WHERE n <= 10) / CAST(count(*) AS DOUBLE) FROM cu) + 1e-10, 6) AS cold_user_share,
 round((SELECT count(*) FILTER (WHERE n <= 10) / CAST(count(*) AS DOUBLE) FROM ci) + 1e-10, 6) AS cold_item_share FROM tr""",
    "rating_error": f"""WITH {INTER},
pos AS (SELECT item_id, rating, least((row_number() OVER (ORDER BY ts, row_key) - 1) // greatest(1, count(*) OVER () // 5), 4) AS fold FROM inter),
means AS (SELECT item_id, avg(rating) AS m FROM pos WHERE fold < 4 GROUP BY 1)
SELECT round(sqrt(avg((m - rating) * (m - rating))) + 1e-10, 6) AS rmse, round(avg(abs(m - rating)) + 1e-10, 6) AS mae, count(*) AS n
FROM pos JOIN means USING (item_id) WHERE fold = 4""",
    "sample_recs": f"""{_TRAIN},
{model_sql('m', 'train')},
five AS (SELECT DISTINCT user_id FROM test ORDER BY 1 LIMIT 5),
picked AS (SELECT * FROM train WHERE user_id IN (SELECT user_id FROM five)
  AND user_id IN (SELECT user_id FROM train GROUP BY 1 HAVING count(*) >= 3)),
{recommend_sql('m', 'picked', top_n=5)}
SELECT user_id, item_id, round(score + 1e-10, 6) AS score, rank FROM recs_m""",
}
