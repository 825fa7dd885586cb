"""Neighbours, content, factors and hybrid lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..operators import factors as fac
from ..operators import hybrid as hy
from ..operators import item_features as itf
from ..operators import ranking_metrics as rm
from ..operators.splits import temporal_split
from ..operators.weights import activity_normalised, with_expertise
from ..plans import hybrid as plan
from ..plans import review_job
from ..session import durable
from ..sources.tables import event_interactions, review_rows, table
from .evaluation import _lists, hits_sql
from .collab_sql import model_sql, recommend_sql
from .sql import EVENTS, INTER, LINES, train_test
from .texts import EXPERT, PART_LEMMAS, PART_LEXICON, features_sql, prepared_sql


def _event_matrix(spark, d):
    ev = event_interactions(spark, d)
    return durable(activity_normalised(ev.select("user_id", "item_id", F.col("weight").alias("w"))))


def _event_reviews(spark, d):
    """Events as reviews: the event type is the text, a purchase is a verified row."""
    ev = event_interactions(spark, d)
    rows = ev.select("user_id", "item_id", "rating", F.col("event_type").alias("text"), "ts", "row_key",
                     F.array(F.lit(0), F.lit(0)).alias("helpful"), (F.col("event_type") == "purchase").alias("verified"))
    return durable(with_expertise(rows))


def _user_knn(spark, d):
    return hy.user_neighbors(_event_matrix(spark, d)).withColumn("sim", shown("sim"))


def _score_user_knn(spark, d):
    matrix = _event_matrix(spark, d)
    return hy.neighbor_scores(durable(hy.user_neighbors(matrix)), matrix).withColumn("cf", shown("cf"))


def _knn_vectors(spark, d):
    out = hy.vector_neighbors(table(spark, d, "embeddings"), "vec_id", "embedding", 50)
    return out.withColumn("sim", shown("sim"))


def _knn_features(spark, d):
    rows = durable(with_expertise(review_rows(spark, d)))
    return hy.feature_neighbors(durable(itf.item_features(rows))).withColumn("sim", shown("sim"))


def _profile(spark, d):
    rows = durable(with_expertise(review_rows(spark, d)))
    return hy.content_profiles(rows, durable(itf.item_features(rows))).withColumn("value", shown("value"))


def _content_parts(rows):
    """Only the content parts; the other tables are empty."""
    features = durable(itf.item_features(rows))
    vectors, numbers = itf.feature_vectors(features)
    numbers, vectors = durable(numbers), durable(vectors)
    pairs = rows.select("user_id", "item_id")
    return hy.HybridParts(
        profiles=durable(hy.unit_profiles(rows, vectors)), vectors=vectors,
        loved=rows.filter("rating >= 4.5").select("user_id", "item_id").distinct(), seen=durable(pairs.distinct()),
        cf=pairs.filter("false").withColumn("cf", F.lit(0.0)),
        bonus=pairs.filter("false").select("item_id", F.lit(0.0).alias("quality"), F.lit(0.0).alias("explore")), width=numbers.count())


def _content_list(love):
    def run(spark, d):
        rows = durable(with_expertise(review_rows(spark, d)))
        parts = _content_parts(rows)
        out = hy.hybrid_topk(parts, rows.select("user_id").distinct(), 10, hy.Blend(0.0, 1.0, 0.0, love, 0.0, False))
        return out.withColumn("score", shown("score"))
    return run


def _quality(spark, d):
    rows = with_expertise(review_rows(spark, d))
    return hy.quality_boost(itf.item_aggregates(rows)).withColumn("quality", shown("quality"))


def _explore(spark, d):
    return hy.exploration_bonus(review_rows(spark, d))


def _hybrid(k, explore):
    def run(spark, d):
        rows = _event_reviews(spark, d)
        parts = plan.build_parts(rows)
        out = hy.hybrid_topk(parts, rows.select("user_id").distinct(), k, hy.Blend(gamma=0.0, explore=explore))
        return out.withColumn("score", shown("score"))
    return run


def _mmr(spark, d):
    rows = _event_reviews(spark, d)
    out = hy.mmr_rerank(plan.build_parts(rows), rows.select("user_id").distinct(), 10, hy.Blend(gamma=0.0), keep=32)
    return out.withColumn("score", shown("score"))


def _mmr_reviews(spark, d):
    rows = durable(with_expertise(review_rows(spark, d)))
    return plan.recommend_hybrid(plan.build_parts(rows), rows, rows.select("user_id").distinct(), 10, hy.Blend(gamma=0.0))


def _from_lines(spark, d):
    """Hybrid lists from JSON text with ids like A12X; a part's name is the review, its type the summary."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type")
    rows = review_rows(spark, d).join(parts, "item_id")
    value = F.to_json(F.struct(
        F.concat(F.lit("A"), "user_id", F.lit("X")).alias("reviewerID"), F.concat(F.lit("B"), "item_id", F.lit("Z")).alias("asin"),
        F.col("rating").alias("overall"), F.col("p_name").alias("reviewText"), F.col("p_type").alias("summary"),
        F.col("helpful"), F.col("verified"), F.col("ts").alias("unixReviewTime")))
    lines = rows.select(value.alias("value"), F.struct("ts", "row_key").alias("seq"), "row_key")
    lexicon = spark.createDataFrame(list(PART_LEXICON.items()), "word string, valence double")
    lemmas = spark.createDataFrame(list(PART_LEMMAS.items()), "form string, lemma string")
    out = review_job.recommend_reviews(lines, 5, hy.Blend(gamma=0.0), lexicon, lemmas)
    return out.withColumn("score", shown("score"))


def _long(factors, side):
    return factors.select(F.lit(side).alias("side"), "id", "vec")


def _svd(spark, d):
    u, v = fac.svd(_event_matrix(spark, d))
    return _long(u, "user").unionByName(_long(v, "item"))


def _nmf(spark, d):
    w, h = fac.nmf(_event_matrix(spark, d))
    return _long(w, "user").unionByName(_long(h, "item"))


def _mf(spark, d):
    u, v = fac.user_item_factors(_event_matrix(spark, d))
    return _long(u, "user").unionByName(_long(v, "item"))


def _factor_checks(spark, d):
    """What SQL can know of the factors: ids, widths, signs, orthonormal directions, errors against the matrix's energy."""
    cells = _event_matrix(spark, d)
    energy = cells.agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    out = None
    for name, (left, right), unsigned in (("svd", fac.svd(cells), False), ("nmf", fac.nmf(cells), True)):
        error = fac.squared_error(cells, left, right)
        gram = fac._gram(right)
        unit = all(abs(x - (i == j and x > 0.5)) < 1e-6 for i, row in enumerate(gram) for j, x in enumerate(row))
        for side, rows in (("user", left), ("item", right)):
            kind = F.when(F.forall("vec", lambda x: x >= 0), "non-negative") if unsigned else F.lit(
                "any" if side == "user" else "orthonormal" if unit else "skew")
            part = rows.select(
                F.lit(name).alias("method"), F.lit(side).alias("side"), F.col("id").cast("bigint").alias("id"),
                F.size("vec").alias("width"), kind.alias("kind"), F.lit(0 <= error + 1e-9 < energy / 2).alias("explains"))
            out = part if out is None else out.unionByName(part)
    return out


def _score_mf(spark, d):
    rows = _event_reviews(spark, d)
    parts = plan.build_parts(rows, 100)
    return hy.hybrid_topk(parts, rows.select("user_id").distinct(), 10, hy.Blend(0.0, 0.0, 1.0, 0.0, 0.0, False))


def _sweep(spark, d):
    train, test = temporal_split(_event_reviews(spark, d))
    return plan.sweep_hybrid(durable(train), durable(test), 10)


def _diversity(spark, d):
    recs, train, test = _lists(spark, d)
    rows = durable(with_expertise(review_rows(spark, d)))
    features = durable(itf.item_features(rows))
    return rm.evaluate_diversity(recs, test, features).withColumn("diversity", shown("diversity"))


QUERIES = {
    "user_knn": _user_knn,
    "score_user_knn": _score_user_knn,
    "item_content_knn": _knn_vectors,
    "item_feature_knn": _knn_features,
    "content_profile": _profile,
    "score_content": _content_list(0.0),
    "score_loved": _content_list(0.3),
    "score_quality": _quality,
    "score_explore": _explore,
    "hybrid_scores": _hybrid(10, True),
    "hybrid_topk": _hybrid(5, False),
    "mmr_rerank": _mmr,
    "recommend_hybrid": _mmr_reviews,
    "hybrid_from_lines": _from_lines,
    "svd_factors": _svd,
    "nmf_factors": _nmf,
    "mf_factors": _mf,
    "factor_checks": _factor_checks,
    "score_mf": _score_mf,
    "sweep_hybrid": _sweep,
    "eval_diversity": _diversity,
}

_EVENT_EXPERT = EVENTS + """,
expert AS (SELECT user_id, item_id, rating, event_type AS text, ts, row_key, 0.5 + 0e0 AS helpfulness,
  event_type = 'purchase' AS verified, 0.5 + 0e0 AS user_expertise FROM ev)"""

_MATRIX = """matrix AS (SELECT user_id, item_id, w / sum(w) OVER (PARTITION BY user_id) AS w FROM
  (SELECT user_id, item_id, sum({w}) AS w FROM {src} GROUP BY 1, 2)),
unorm AS (SELECT user_id, sqrt(sum(w * w)) AS norm FROM matrix GROUP BY 1),
ucos AS (SELECT a.user_id, b.user_id AS neighbor, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 9) AS sim
  FROM matrix a JOIN matrix b ON a.item_id = b.item_id AND a.user_id <> b.user_id
  JOIN unorm x ON x.user_id = a.user_id JOIN unorm y ON y.user_id = b.user_id GROUP BY 1, 2),
nn AS (SELECT * FROM ucos WHERE sim > 0.5
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, neighbor) <= least(200, (SELECT count(*) // 5 FROM unorm)) - 1),
cf AS (SELECT n.user_id, m.item_id, sum((exp(2 * sim) - 1) * m.w) / any_value(t) AS cf FROM nn n JOIN matrix m ON m.user_id = n.neighbor
  JOIN (SELECT user_id, sum(exp(2 * sim) - 1) AS t FROM nn GROUP BY 1) s ON s.user_id = n.user_id GROUP BY 1, 2)"""

_LINE_EXPERT = LINES + f""",
{prepared_sql(PART_LEMMAS)},
helped AS (SELECT 'A' || user_id || 'X' AS user_id, 'B' || item_id || 'Z' AS item_id, rating, text, ts, row_key, verified,
  CASE WHEN votes > 0 THEN CAST(least(ups, votes) AS DOUBLE) / votes ELSE 0.5 END AS helpfulness
  FROM lines JOIN prepared ON p_partkey = item_id),
expert AS (SELECT *, avg(helpfulness) OVER (PARTITION BY user_id) AS user_expertise FROM helped)"""

_SIGNAL = """(rating / 5.0) * sqrt(1 + 0.5 * CAST(ts - (SELECT min(ts) FROM expert) AS DOUBLE)
   / ((SELECT max(ts) FROM expert) - (SELECT min(ts) FROM expert) + 1)) * (1 + CAST(0.3 AS DOUBLE) * helpfulness)
   * (1 + CAST(0.2 AS DOUBLE) * CAST(verified AS INTEGER)) * (1 + CAST(0.2 AS DOUBLE) * user_expertise)"""

_PROFILE = """lastr AS (SELECT user_id, item_id, arg_max(rating, row(ts, row_key)) AS rating FROM expert GROUP BY 1, 2),
wts AS (SELECT user_id, item_id, CASE WHEN rating >= 4 THEN (rating / 5.0) * (rating / 5.0) ELSE rating / 5.0 END AS w0 FROM lastr),
wn AS (SELECT user_id, item_id, w0 / (sum(w0) OVER (PARTITION BY user_id) + 1e-8) AS w FROM wts),
profile AS (SELECT user_id, feature, sum(w * value) AS value FROM wn JOIN feats USING (item_id) GROUP BY 1, 2)"""

_CONTENT = """pn AS (SELECT user_id, sqrt(sum(value * value)) AS n FROM profile GROUP BY 1),
fn AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM feats GROUP BY 1),
content AS (SELECT p.user_id, f.item_id, sum(p.value * f.value) / (any_value(pn.n) * any_value(fn.n)) AS c
  FROM profile p JOIN feats f USING (feature) JOIN pn ON pn.user_id = p.user_id JOIN fn ON fn.item_id = f.item_id GROUP BY 1, 2),
icos AS (SELECT a.item_id AS l, b.item_id, sum(a.value * b.value) / (any_value(x.n) * any_value(y.n)) AS c
  FROM feats a JOIN feats b USING (feature) JOIN fn x ON x.item_id = a.item_id JOIN fn y ON y.item_id = b.item_id GROUP BY 1, 2),
love AS (SELECT v.user_id, i.item_id, max(c) AS c FROM (SELECT DISTINCT user_id, item_id FROM expert WHERE rating >= 4.5) v
  JOIN icos i ON i.l = v.item_id GROUP BY 1, 2)"""

_BONUS = """quality AS (SELECT item_id, CASE WHEN rating_mean >= 4.0 AND rating_count >= 10 AND coalesce(rating_std < 1.0, false)
  THEN (rating_mean - 3.5) * ln(1 + rating_count) / 10 ELSE 0 END AS quality FROM aggs),
explore AS (SELECT item_id, CASE WHEN pct > 0.3 AND pct < 0.7 THEN 0.1 + 0e0 ELSE 0 END AS explore FROM (
  SELECT item_id, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER () AS pct
  FROM (SELECT item_id, count(*) AS n FROM expert GROUP BY 1)))"""


def _content_sql(love: str) -> str:
    value = "c.c" if love == "0" else f"c.c + CAST({love} AS DOUBLE) * coalesce(l.c, 0)"
    extra = "" if love == "0" else "LEFT JOIN love l ON l.user_id = c.user_id AND l.item_id = c.item_id"
    return f"""WITH {EXPERT}, {features_sql()},
{_PROFILE},
{_CONTENT},
s AS (SELECT c.user_id, c.item_id, round({value}, 9) AS score FROM content c {extra}
  WHERE NOT EXISTS (SELECT 1 FROM expert e WHERE e.user_id = c.user_id AND e.item_id = c.item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10)
SELECT user_id, item_id, round(score + 1e-10, 6) AS score, rank FROM r"""


def _scores_sql(explore: bool, expert: str = _EVENT_EXPERT) -> str:
    """CTE s(user_id, item_id, score) of all unseen items, without the factor part."""
    return f"""WITH {expert}, {features_sql()},
{_PROFILE},
{_CONTENT},
{_BONUS},
sig AS (SELECT user_id, item_id, {_SIGNAL} AS w FROM expert),
{_MATRIX.format(w='w', src='sig')},
s AS (SELECT c.user_id, c.item_id, round(CAST(0.2 AS DOUBLE) * quality {'+ explore' if explore else ''}
   + CAST(0.3 AS DOUBLE) * (c.c + CAST(0.3 AS DOUBLE) * coalesce(l.c, 0)) + CAST(0.3 AS DOUBLE) * coalesce(cf, 0), 9) AS score
  FROM content c JOIN quality USING (item_id) JOIN explore USING (item_id)
  LEFT JOIN love l ON l.user_id = c.user_id AND l.item_id = c.item_id
  LEFT JOIN cf ON cf.user_id = c.user_id AND cf.item_id = c.item_id
  WHERE NOT EXISTS (SELECT 1 FROM expert e WHERE e.user_id = c.user_id AND e.item_id = c.item_id))"""


def _hybrid_sql(k: int, explore: bool, expert: str = _EVENT_EXPERT) -> str:
    return f"""{_scores_sql(explore, expert)},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= {k})
SELECT user_id, item_id, round(score + 1e-10, 6) AS score, rank FROM r"""


def _mmr_sql(k: int) -> str:
    """The greedy unrolled: n<j> holds the open items with their largest cosine to the chosen ones, p<j> the j-th choice."""
    steps = ["""n1 AS (SELECT user_id, item_id, score, CAST(-1 AS DOUBLE) AS near FROM s),
p1 AS (SELECT user_id, item_id, score FROM n1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) = 1)"""]
    for j in range(2, k + 1):
        steps.append(f"""n{j} AS (SELECT c.user_id, c.item_id, c.score, greatest(c.near, coalesce(i.c, 0)) AS near
  FROM n{j - 1} c JOIN p{j - 1} p ON p.user_id = c.user_id AND p.item_id <> c.item_id
  LEFT JOIN icos i ON i.l = p.item_id AND i.item_id = c.item_id),
p{j} AS (SELECT user_id, item_id, score FROM n{j} QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY round(CAST(0.7 AS DOUBLE) * score + CAST(0.3 AS DOUBLE) * (1 - near), 9) DESC, item_id) = 1)""")
    picks = " UNION ALL ".join(f"SELECT user_id, item_id, round(score + 1e-10, 6) AS score, CAST({j} AS BIGINT) AS rank FROM p{j}" for j in range(1, k + 1))
    return f"{_scores_sql(True)},\n" + ",\n".join(steps) + "\n" + picks


_KNN = f"WITH {EVENTS}, {_MATRIX.format(w='weight', src='ev')}"

ORACLES = {
    "user_knn": f"{_KNN} SELECT user_id, neighbor, round(sim + 1e-10, 6) AS sim FROM nn",
    "score_user_knn": f"{_KNN} SELECT user_id, item_id, round(cf + 1e-10, 6) AS cf FROM cf",
    "item_content_knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbor, round(list_cosine_similarity(a.e, b.e), 9) AS sim FROM v a, v b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbor) AS rank FROM s QUALIFY rank <= 50)
SELECT vec_id, neighbor, round(sim + 1e-10, 6) AS sim, rank FROM r""",
    "item_feature_knn": f"""WITH {EXPERT}, {features_sql()},
fn AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM feats GROUP BY 1),
s AS (SELECT a.item_id, b.item_id AS neighbor, round(sum(a.value * b.value) / (any_value(x.n) * any_value(y.n)), 9) AS sim
  FROM feats a JOIN feats b ON a.feature = b.feature AND a.item_id <> b.item_id JOIN fn x ON x.item_id = a.item_id
  JOIN fn y ON y.item_id = b.item_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbor) AS rank FROM s WHERE sim > 0.8 QUALIFY rank <= 50)
SELECT item_id, neighbor, round(sim + 1e-10, 6) AS sim, rank FROM r""",
    "content_profile": f"WITH {EXPERT}, {features_sql()}, {_PROFILE} SELECT user_id, feature, round(value + 1e-10, 6) AS value FROM profile",
    "score_content": _content_sql("0"),
    "score_loved": _content_sql("0.3"),
    "score_quality": f"WITH {EXPERT}, {features_sql()}, {_BONUS} SELECT item_id, round(quality + 1e-10, 6) AS quality FROM quality",
    "score_explore": f"WITH {EXPERT}, {features_sql()}, {_BONUS} SELECT item_id, explore FROM explore",
    "hybrid_scores": _hybrid_sql(10, True),
    "hybrid_topk": _hybrid_sql(5, False),
    "mmr_rerank": _mmr_sql(10),
    "hybrid_from_lines": _hybrid_sql(5, False, _LINE_EXPERT),
    "factor_checks": f"""WITH {EVENTS}, ids AS (
  SELECT DISTINCT 'user' AS side, user_id AS id FROM ev UNION ALL SELECT DISTINCT 'item', item_id FROM ev)
SELECT method, side, id, CAST(width AS INTEGER) AS width,
  CASE WHEN method = 'nmf' THEN 'non-negative' WHEN side = 'item' THEN 'orthonormal' ELSE 'any' END AS kind, true AS explains
FROM ids, (VALUES ('svd', 100), ('nmf', 50)) m(method, width)""",
    "eval_diversity": f"""WITH {EXPERT.replace(LINES, INTER)},
{features_sql()},
{train_test()},
{model_sql('m', 'train')},
{recommend_sql('m', 'train')},
{hits_sql('m', 10)},
fn AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM feats GROUP BY 1),
prs AS (SELECT x.user_id, x.item_id AS a, y.item_id AS b FROM flag_m x JOIN flag_m y ON x.user_id = y.user_id AND x.item_id < y.item_id),
cs AS (SELECT a, b, sum(f.value * g.value) / (any_value(m.n) * any_value(o.n)) AS c FROM (SELECT DISTINCT a, b FROM prs)
  JOIN feats f ON f.item_id = a JOIN feats g ON g.item_id = b AND g.feature = f.feature JOIN fn m ON m.item_id = a JOIN fn o ON o.item_id = b GROUP BY 1, 2),
pu AS (SELECT user_id, 1 - avg(coalesce(c, 0)) AS d FROM prs LEFT JOIN cs USING (a, b) GROUP BY 1)
SELECT round(sum(d) / (SELECT count(DISTINCT user_id) FROM flag_m) + 1e-10, 6) AS diversity FROM pu""",
}
