"""Similarity, popularity and item-based recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..functions.skew import heavy_keys
from ..operators import popularity as pops
from ..operators import recommend as rec
from ..operators import similarity as sims
from ..operators.splits import flag_stratified, split
from ..operators.weights import interaction_weight, item_idf, user_item_cells
from ..session import durable
from ..sources.tables import event_interactions, interactions, table
from .collab_sql import (backfill_sql, candidates_sql, cells_sql, fallback_sql, history_sql, model_sql, pairs_sql,
                         popularity_sql, recommend_sql, sim_sql)
from .sql import EVENTS, INTER, train_test


def train_and_test(spark, d):
    return split(durable(flag_stratified(interactions(spark, d))))


def _cells(spark, d):
    return user_item_cells(interaction_weight(interactions(spark, d)))


def _sim(method, k=50, min_similarity=0.0001, idf=False):
    def run(spark, d):
        df = interactions(spark, d)
        cells = durable(_cells(spark, d))
        out = sims.item_neighbors(cells, method, k, min_similarity, item_idf(cells) if idf else None,
                                  heavy_users=heavy_keys(df, "user_id"), heavy_items=heavy_keys(df, "item_id"))
        return out.select("item_id", "neighbor", shown("sim").alias("sim"), "rank")
    return run


def _ratings(df):
    """One rating per (user, item): the mean of repeats."""
    return df.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def _common(measure, support, user_based, source):
    def run(spark, d):
        out = sims.common_rater_similarity(_ratings(source(spark, d)), measure, user_based, support)
        return out.select("a", "b", "support", shown("sim").alias("sim"))
    return run


def _popular(spark, d):
    return pops.item_popularity(interactions(spark, d))


def _popular_fallback(spark, d):
    df = interactions(spark, d)
    out = pops.popular_for(df.select("user_id").distinct(), df.select("user_id", "item_id").distinct(),
                           pops.popular_items(_popular(spark, d)))
    return out.select("user_id", "item_id", shown("score").alias("score"), "rank")


def _recs(out):
    return out.select("user_id", "item_id", shown("score").alias("score"), "rank")


def _model_and_history(spark, d, settings=rec.Settings()):
    train, _ = train_and_test(spark, d)
    model = rec.fit(train, settings)
    return model, durable(rec.history_cells(train, settings.time_decay_factor)), train


def _candidates(spark, d):
    model, history, _ = _model_and_history(spark, d)
    out = rec.scored_candidates(history, model.sim, model.heavy_items)
    return out.select("user_id", "item_id", shown("score").alias("score"))


def _penalty(spark, d):
    model, history, _ = _model_and_history(spark, d)
    out = rec.scored_candidates(history, model.sim, model.heavy_items)
    return out.select("user_id", "item_id", shown(1.0 - 0.2 * F.col("closeness")).alias("penalty"))


def _backfill(spark, d):
    """Few neighbours per item, so that many users run short of candidates."""
    model, history, _ = _model_and_history(spark, d, rec.Settings(k=1))
    found = rec.scored_candidates(history, model.sim, model.heavy_items)
    out = rec.cooccurrence_backfill(history, model.cells, found, 10)
    return out.select("user_id", "item_id", shown("score").alias("score"))


def recommend_cf(spark, d):
    train, _ = train_and_test(spark, d)
    return _recs(rec.recommend(rec.fit(train), train))


def _recommend_fallback(spark, d):
    """A threshold that no similarity reaches: users are served by co-occurrence from their whole history, customers
    without any by the popular list."""
    train, test = train_and_test(spark, d)
    strict = rec.fit(train, rec.Settings(min_similarity=1e6))
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("user_id"))
    out = rec.recommend(strict, train, users=customers.unionByName(test.select("user_id")).distinct())
    return _recs(out)


QUERIES = {
    "cooccurrence": lambda s, d: sims.cooccurrence(_cells(s, d)),
    "sim_cosine": _sim("enhanced_cosine", idf=True),
    "sim_jaccard": _sim("jaccard"),
    "sim_tanimoto": _sim("tanimoto"),
    "sim_pearson": _sim("pearson"),
    "sim_common_cosine": _common("cosine", 2, False, interactions),
    "sim_msd": _common("msd", 3, True, event_interactions),
    "popularity": lambda s, d: _popular(s, d).select("item_id", shown("pop").alias("pop")),
    "popular_items": lambda s, d: pops.popular_items(_popular(s, d)).select("item_id", shown("pop").alias("pop"), "rank"),
    "popular_fallback": _popular_fallback,
    "popularity_pct": lambda s, d: pops.popularity_percentile(interactions(s, d)).select(
        "item_id", "n", shown("pct").alias("pct")),
    "coldstart_best": lambda s, d: pops.best_rated(interactions(s, d), 10, 25).select(
        "item_id", shown("rating_mean").alias("rating_mean"), "rating_count"),
    "history_weights": lambda s, d: rec.history_weights(interactions(s, d)).select(
        "row_key", "pos", shown("weight").alias("weight")),
    "cf_candidates": _candidates,
    "cooc_backfill": _backfill,
    "diversity_penalty": _penalty,
    "recommend_cf": recommend_cf,
    "recommend_fallback": _recommend_fallback,
}

_TRAIN = f"WITH {INTER},\n{train_test()}"
_SIM_OUT = "SELECT item_id, neighbor, round(sim + 1e-10, 6) AS sim, rank FROM sim_m"
_RECS_OUT = "SELECT user_id, item_id, round(score + 1e-10, 6) AS score, rank FROM recs_m"


def _sim_oracle(method, idf=False):
    return f"WITH {INTER},\n{cells_sql('m', 'inter', 0.95)},\n{pairs_sql('m')},\n{sim_sql('m', method, 50, 0.0001, idf)}\n{_SIM_OUT}"


def _common_oracle(head, src, key, member, support, value):
    return f"""WITH {head},
r AS (SELECT user_id, item_id, avg(rating) AS rating FROM {src} GROUP BY 1, 2)
SELECT a.{member} AS a, b.{member} AS b, count(*) AS support,
       round(round(CASE WHEN count(*) >= {support} THEN {value} ELSE 0.0 END, 9) + 1e-10, 6) AS sim
FROM r a JOIN r b ON a.{key} = b.{key} AND a.{member} < b.{member} GROUP BY 1, 2"""


_POP = f"WITH {INTER},\n{popularity_sql('m', 'inter', 0.95)}"
_CAND = f"{_TRAIN},\n{model_sql('m', 'train')},\n{history_sql('m', 'train', 0.95)},\n{candidates_sql('m')}"

ORACLES = {
    "cooccurrence": f"""WITH {INTER},
SELF AS (SELECT user_id, item_id, row_key FROM inter)
SELECT a.item_id, b.item_id AS neighbor, count(*) AS n
FROM SELF a JOIN SELF b ON a.user_id = b.user_id AND a.row_key <> b.row_key GROUP BY 1, 2""",
    "sim_cosine": _sim_oracle("enhanced_cosine", True),
    "sim_jaccard": _sim_oracle("jaccard"),
    "sim_tanimoto": _sim_oracle("tanimoto"),
    "sim_pearson": _sim_oracle("pearson"),
    "sim_common_cosine": _common_oracle(
        INTER, "inter", "user_id", "item_id", 2,
        "sum(a.rating * b.rating) / sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating))"),
    "sim_msd": _common_oracle(
        EVENTS, "ev", "item_id", "user_id", 3, "1 / (avg((a.rating - b.rating) * (a.rating - b.rating)) + 1)"),
    "popularity": f"{_POP} SELECT item_id, round(pop + 1e-10, 6) AS pop FROM pop_m",
    "popular_items": f"{_POP} SELECT item_id, round(pop + 1e-10, 6) AS pop, rank FROM popular_m",
    "popular_fallback": f"""{_POP},
hist_m AS (SELECT DISTINCT user_id, item_id FROM inter),
everyone AS (SELECT DISTINCT user_id FROM inter),
{fallback_sql('m', 10, 'everyone')}
SELECT user_id, item_id, round(score + 1e-10, 6) AS score, rank FROM fall_m""",
    "popularity_pct": f"""WITH {INTER},
sizes AS (SELECT item_id, count(*) AS n FROM inter GROUP BY 1)
SELECT item_id, n, round((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0)
       / count(*) OVER () + 1e-10, 6) AS pct FROM sizes""",
    "coldstart_best": f"""WITH {INTER},
agg AS (SELECT item_id, round(avg(rating), 9) AS m, count(*) AS c FROM inter GROUP BY 1),
top AS (SELECT * FROM agg ORDER BY m DESC, item_id LIMIT 20)
SELECT item_id, round(m + 1e-10, 6) AS rating_mean, c AS rating_count FROM
 (SELECT * FROM top WHERE c >= 25 ORDER BY m DESC, item_id LIMIT 10)""",
    "history_weights": f"""WITH {INTER},
r AS (SELECT row_key, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) AS pos,
             count(*) OVER (PARTITION BY user_id) AS n FROM inter)
SELECT row_key, pos, round(pow(CAST(0.95 AS DOUBLE), n - pos)
       / sum(pow(CAST(0.95 AS DOUBLE), n - pos)) OVER (PARTITION BY user_id) + 1e-10, 6) AS weight FROM r""",
    "cf_candidates": f"{_CAND}\nSELECT user_id, item_id, round(score + 1e-10, 6) AS score FROM cand_m",
    "diversity_penalty": f"""{_CAND}
SELECT user_id, item_id, round(1 - CAST(0.2 AS DOUBLE) * closeness + 1e-10, 6) AS penalty FROM cand_m""",
    "cooc_backfill": f"""{_TRAIN},
{model_sql('m', 'train', k=1)},
{history_sql('m', 'train', 0.95)},
{candidates_sql('m')},
{backfill_sql('m', 10)}
SELECT user_id, item_id, round(score + 1e-10, 6) AS score FROM extra_m""",
    "recommend_cf": f"{_TRAIN},\n{model_sql('m', 'train')},\n{recommend_sql('m', 'train')}\n{_RECS_OUT}",
    "recommend_fallback": f"""{_TRAIN},
{model_sql('m', 'train', min_sim=1e6)},
{recommend_sql('m', 'train', users='(SELECT CAST(c_custkey AS BIGINT) AS user_id FROM customer UNION SELECT user_id FROM test)')}
{_RECS_OUT}""",
}
