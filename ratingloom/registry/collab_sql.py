"""DuckDB builders for the item-based recommender."""

from __future__ import annotations

from .sql import decay as decay_expr

MEASURES = {
    "enhanced_cosine": "dot / (sqrt(ia.sq) * sqrt(ib.sq)) * (1 + cooc / 100.0)",
    "jaccard": "common / CAST(ia.holders + ib.holders - common AS DOUBLE) * (1 + cooc / 100.0)",
    "tanimoto": "dot / (ia.sq + ib.sq - dot)",
    "pearson": """(dot - nu * (ia.tot / nu) * (ib.tot / nu))
      / (sqrt(ia.sq - nu * (ia.tot / nu) * (ia.tot / nu)) * sqrt(ib.sq - nu * (ib.tot / nu) * (ib.tot / nu)))""",
}


def cells_sql(tag: str, src: str, decay: float) -> str:
    return f"""weighted_{tag} AS (SELECT *, {decay_expr('ts', src, decay)} AS w FROM {src}),
cells_{tag} AS (SELECT user_id, item_id, sum(w) AS w, count(*) AS n FROM weighted_{tag} GROUP BY 1, 2)"""


def pairs_sql(tag: str) -> str:
    return f"""pairs_{tag} AS (
  SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS dot, CAST(sum(a.n * b.n) AS DOUBLE) AS cooc,
         CAST(count(*) FILTER (WHERE a.w > 0 AND b.w > 0) AS DOUBLE) AS common
  FROM cells_{tag} a JOIN cells_{tag} b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
items_{tag} AS (SELECT item_id, sum(w * w) AS sq, sum(w) AS tot, count(*) FILTER (WHERE w > 0) AS holders
  FROM cells_{tag} GROUP BY 1)"""


def sim_sql(tag: str, method: str, k: int, min_sim: float, idf: bool, pairs: str | None = None) -> str:
    """CTE sim_<tag>(item_id, neighbor, sim, rank) on cells_/pairs_/items_ of ``pairs`` (default tag)."""
    p = pairs or tag
    scaled = idf and method == "enhanced_cosine"
    floor = 0 if scaled else min_sim
    out = f"""base_{tag} AS (
  SELECT i AS item_id, j AS neighbor, round({MEASURES[method]}, 9) AS sim
  FROM pairs_{p} JOIN items_{p} ia ON ia.item_id = i JOIN items_{p} ib ON ib.item_id = j,
       (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS nu FROM cells_{p})),
top_{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, neighbor) AS rank
  FROM base_{tag} WHERE sim > CAST({floor} AS DOUBLE) QUALIFY rank <= {k})"""
    if not scaled:
        return out + f",\nsim_{tag} AS (SELECT * FROM top_{tag})"
    return out + f""",
idf_{tag} AS (SELECT item_id, ln(CAST((SELECT count(DISTINCT user_id) FROM cells_{p}) AS DOUBLE) / (1 + holders)) AS idf
  FROM items_{p}),
sim_{tag} AS (SELECT item_id, neighbor, round(sim * idf, 9) AS sim, rank FROM top_{tag} JOIN idf_{tag} USING (item_id)
  WHERE round(sim * idf, 9) > CAST({min_sim} AS DOUBLE))"""


def popularity_sql(tag: str, src: str, decay: float) -> str:
    return f"""pop_{tag} AS (SELECT item_id, round(sum({decay_expr('ts', src, decay)}) / (SELECT count(*) FROM {src}), 9) AS pop
  FROM {src} GROUP BY 1),
popular_{tag} AS (SELECT *, row_number() OVER (ORDER BY pop DESC, item_id) AS rank FROM pop_{tag}
  QUALIFY rank <= least(100, CAST(floor((SELECT count(*) FROM pop_{tag}) * CAST(0.3 AS DOUBLE)) AS BIGINT)))"""


def model_sql(tag: str, src: str, method="enhanced_cosine", k=50, min_sim=0.0001, decay=0.95, idf=True) -> str:
    return ",\n".join([cells_sql(tag, src, decay), pairs_sql(tag), sim_sql(tag, method, k, min_sim, idf),
                       popularity_sql(tag, src, decay)])


def history_sql(tag: str, src: str, decay: float) -> str:
    return f"""hrows_{tag} AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM {src}),
hweights_{tag} AS (SELECT *, pow(CAST({decay} AS DOUBLE), n - pos) / sum(pow(CAST({decay} AS DOUBLE), n - pos))
         OVER (PARTITION BY user_id) AS weight FROM hrows_{tag}),
hist_{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) <= 10 AS recent FROM (
    SELECT user_id, item_id, sum(weight) AS weight, max(pos) AS pos FROM hweights_{tag} GROUP BY 1, 2))"""


def candidates_sql(tag: str) -> str:
    return f"""cand_{tag} AS (
  SELECT h.user_id, s.neighbor AS item_id, sum(s.sim * h.weight) AS score,
         coalesce(max(s.sim) FILTER (WHERE h.recent), 0) AS closeness
  FROM hist_{tag} h JOIN sim_{tag} s USING (item_id)
  WHERE NOT EXISTS (SELECT 1 FROM hist_{tag} x WHERE x.user_id = h.user_id AND x.item_id = s.neighbor)
  GROUP BY 1, 2)"""


def backfill_sql(tag: str, top_n: int, out: str | None = None) -> str:
    out = out or tag
    return f"""short_{out} AS (
  SELECT h.user_id, h.item_id, h.pos FROM hrows_{tag} h
  WHERE h.pos > h.n - 5
    AND (SELECT count(*) FROM cand_{tag} c WHERE c.user_id = h.user_id) < {2 * top_n}),
cooc_{out} AS (
  SELECT i, j, cooc FROM pairs_{tag}
  UNION ALL SELECT item_id, item_id, CAST(sum(n * (n - 1)) AS DOUBLE) FROM cells_{tag} GROUP BY 1 HAVING sum(n * (n - 1)) > 0),
cotop_{out} AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cooc DESC, j) AS r FROM cooc_{out}
  WHERE i IN (SELECT item_id FROM short_{out}) QUALIFY r <= 20),
extra_{out} AS (
  SELECT s.user_id, t.j AS item_id, arg_min(t.cooc, s.pos) / 100.0 AS score
  FROM short_{out} s JOIN cotop_{out} t ON t.i = s.item_id
  WHERE NOT EXISTS (SELECT 1 FROM hist_{tag} x WHERE x.user_id = s.user_id AND x.item_id = t.j)
    AND NOT EXISTS (SELECT 1 FROM cand_{tag} c WHERE c.user_id = s.user_id AND c.item_id = t.j)
  GROUP BY 1, 2)"""


def fallback_sql(tag: str, top_n: int, without: str, out: str | None = None) -> str:
    """CTE fall_<out>: popular items for the users of CTE ``without``."""
    return f"""fall_{out or tag} AS (
  SELECT user_id, item_id, score, rk AS rank FROM (
    SELECT u.user_id, p.item_id, p.pop AS score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.rank) AS rk
    FROM {without} u, popular_{tag} p
    WHERE p.rank <= {2 * top_n}
      AND NOT EXISTS (SELECT 1 FROM hist_{tag} x WHERE x.user_id = u.user_id AND x.item_id = p.item_id))
  WHERE rk <= {top_n})"""


def finish_sql(tag: str, top_n=10, popularity_weight=0.2, diversity=0.2, users: str | None = None,
               out: str | None = None) -> str:
    """CTE recs_<out>(user_id, item_id, score, rank) from hist_/cand_ of ``tag``."""
    out = out or tag
    everyone = f"SELECT DISTINCT user_id FROM hist_{tag}" + (f" UNION SELECT user_id FROM {users}" if users else "")
    return ",\n".join([
        backfill_sql(tag, top_n, out),
        f"""final_{out} AS (
  SELECT user_id, item_id, round((score + coalesce(pop, 0) * CAST({popularity_weight} AS DOUBLE))
         * (1 - CAST({diversity} AS DOUBLE) * closeness), 9) AS score
  FROM (SELECT user_id, item_id, score, closeness FROM cand_{tag}
        UNION ALL SELECT user_id, item_id, score, 0 FROM extra_{out}) LEFT JOIN pop_{tag} USING (item_id)),
best_{out} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM final_{out}
  QUALIFY rank <= {top_n}),
without_{out} AS (SELECT user_id FROM ({everyone}) WHERE user_id NOT IN (SELECT user_id FROM final_{out}))""",
        fallback_sql(tag, top_n, f"without_{out}", out),
        f"recs_{out} AS (SELECT * FROM best_{out} UNION ALL SELECT * FROM fall_{out})",
    ])


def recommend_sql(tag: str, src: str, decay=0.95, top_n=10, popularity_weight=0.2, diversity=0.2,
                  users: str | None = None) -> str:
    """CTE recs_<tag> after model_sql of the same tag."""
    return ",\n".join([history_sql(tag, src, decay), candidates_sql(tag),
                       finish_sql(tag, top_n, popularity_weight, diversity, users)])
