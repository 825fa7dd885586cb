"""Training sets and batches."""

from __future__ import annotations

from ..operators import training_sets as ts
from ..session import durable
from ..sources.tables import event_interactions, interactions
from .sql import EVENTS, INTER, key_long


def _encoded(spark, d):
    return durable(ts.encoded(interactions(spark, d)))


def _event_samples(spark, d):
    """Ten repeated negatives per event; many users have seen most of the items."""
    ev = event_interactions(spark, d).select("user_id", "item_id", "rating", "ts", "row_key")
    return ts.training_set(ev, 2)


QUERIES = {
    "train_positives": lambda s, d: ts.positives(_encoded(s, d)),
    "train_negatives": lambda s, d: ts.negatives(_encoded(s, d)),
    "train_set_events": _event_samples,
    "user_items": lambda s, d: ts.items_of_users(interactions(s, d)),
    "item_users": lambda s, d: ts.users_of_items(interactions(s, d)),
    "user_batches": lambda s, d: ts.user_batches(interactions(s, d)),
    "mini_batches": lambda s, d: ts.mini_batches(interactions(s, d).select("row_key")).select("row_key", "batch_id"),
    "mini_batches_ordered": lambda s, d: ts.mini_batches(interactions(s, d).select("ts", "row_key"), 500, False).select("row_key", "batch_id"),
    "validate_samples": lambda s, d: ts.validate_samples(durable(_event_samples(s, d))),
}


def _encoded_sql(head: str, src: str) -> str:
    return f"""WITH {head},
fu AS (SELECT user_id, row_number() OVER (ORDER BY f) - 1 AS user_idx FROM (SELECT user_id, min(row(ts, row_key)) AS f FROM {src} GROUP BY 1)),
fi AS (SELECT item_id, row_number() OVER (ORDER BY f) - 1 AS item_idx FROM (SELECT item_id, min(row(ts, row_key)) AS f FROM {src} GROUP BY 1)),
enc AS (SELECT * FROM {src} JOIN fu USING (user_id) JOIN fi USING (item_id))"""


def _samples_sql(head: str, src: str, ratio: int) -> str:
    return f"""{_encoded_sql(head, src)},
pos AS (SELECT row_key, 0 AS draw, user_idx, item_idx, CAST(rating AS FLOAT) AS rating, CAST(1 AS FLOAT) AS label, ts FROM enc),
seen AS (SELECT user_idx, item_idx, item_idx - row_number() OVER (PARTITION BY user_idx ORDER BY item_idx) + 1 AS gap
  FROM (SELECT DISTINCT user_idx, item_idx FROM enc)),
held AS (SELECT user_idx, count(*) AS h FROM seen GROUP BY 1),
ni AS (SELECT count(DISTINCT item_idx) AS n FROM enc),
draws AS (SELECT row_key, draw, user_idx, ts, n - h AS free, {key_long("md5('42|' || row_key || '|' || draw)")} % (CASE WHEN n > h THEN n - h ELSE n END) AS r
  FROM enc JOIN held USING (user_idx), ni, (SELECT CAST(i AS INTEGER) AS draw FROM range(1, {ratio + 1}) t(i))),
neg AS (SELECT row_key, draw, user_idx,
   r + CASE WHEN free > 0 THEN (SELECT count(*) FROM seen s WHERE s.user_idx = d.user_idx AND s.gap <= d.r) ELSE 0 END AS item_idx,
   CAST(0 AS FLOAT) AS rating, CAST(0 AS FLOAT) AS label, ts FROM draws d)"""


_EV = _samples_sql(EVENTS, "ev", 2)

ORACLES = {
    "train_positives": f"{_samples_sql(INTER, 'inter', 4)} SELECT * FROM pos",
    "train_negatives": f"{_samples_sql(INTER, 'inter', 4)} SELECT * FROM neg",
    "train_set_events": f"{_EV} SELECT * FROM pos UNION ALL SELECT * FROM neg",
    "user_items": f"WITH {INTER} SELECT DISTINCT user_id, item_id FROM inter",
    "item_users": f"WITH {INTER} SELECT DISTINCT item_id, user_id FROM inter",
    "user_batches": f"""WITH {INTER},
u AS (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 4)),
p AS (SELECT user_id, row_key, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|' || row_key), row_key) AS r FROM inter)
SELECT i // 8 AS batch_id, user_id, row_key FROM p JOIN u USING (user_id) WHERE r <= 4 AND i // 8 < n // 8""",
    "mini_batches": f"""WITH {INTER}
SELECT row_key, (row_number() OVER (ORDER BY md5('42|' || row_key), row_key) - 1) // 32 AS batch_id FROM inter""",
    "mini_batches_ordered": f"""WITH {INTER}
SELECT row_key, (row_number() OVER (ORDER BY ts, row_key) - 1) // 500 AS batch_id FROM inter""",
    "validate_samples": f"""{_EV},
every AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)
SELECT count(*) AS n_samples, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative,
 0 AS n_null, min(user_idx) AS min_user, max(user_idx) AS max_user, min(item_idx) AS min_item, max(item_idx) AS max_item,
 (SELECT count(*) FROM neg WHERE EXISTS (SELECT 1 FROM pos WHERE pos.user_idx = neg.user_idx AND pos.item_idx = neg.item_idx)) AS n_negative_seen
FROM every""",
}
