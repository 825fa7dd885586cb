"""DuckDB text blocks shared by the oracle statements."""

EPOCH = "CAST(floor(epoch({0})) AS BIGINT)"

LINES = """lines AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating,
         CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts,
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(floor(epoch(l_shipdate)) AS BIGINT)) AS row_key,
         CAST(round(l_tax * 100) AS INTEGER) AS votes,
         CAST(round(l_discount * 100) AS INTEGER) AS ups,
         (l_returnflag = 'N') AS verified
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

INTER = LINES + """,
inter AS (SELECT user_id, item_id, rating, ts, row_key FROM lines)"""

REVIEWS = LINES + """,
reviews AS (
  SELECT user_id, item_id, rating, p_name || ' ' || p_brand || ' ' || p_type AS text, ts,
         least(ups, votes) AS ups, votes, verified, row_key
  FROM lines JOIN part ON p_partkey = item_id)"""

EVENTS = """ev AS (
  SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id,
         CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) AS rating,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, lpad(CAST(event_id AS VARCHAR), 20, '0') AS row_key,
         value AS weight, event_type
  FROM events)"""


def train_test(src: str = "inter", ratio: float = 0.2, min_train: int = 2) -> str:
    """CTEs train and test: latest rows per user to test."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_key) AS rn,
         count(*) OVER (PARTITION BY user_id) AS cnt FROM {src}),
flagged AS (
  SELECT *, cnt >= {min_train + 1} AND rn > cnt - greatest(1, least(CAST(floor(cnt * CAST({ratio} AS DOUBLE)) AS BIGINT),
         cnt - {min_train})) AS is_test FROM ranked),
train AS (SELECT * EXCLUDE (rn, cnt, is_test) FROM flagged WHERE NOT is_test),
test AS (SELECT * EXCLUDE (rn, cnt, is_test) FROM flagged WHERE is_test)"""


def decay(expr_ts: str, src: str, d: float) -> str:
    return (f"pow(CAST({d} AS DOUBLE), CAST(floor(((SELECT max(ts) FROM {src}) - {expr_ts}) / 86400.0) AS DOUBLE)"
            f" / CAST(365 AS DOUBLE))")


def key_long(expr: str) -> str:
    return f"CAST(('0x' || substr({expr}, 1, 15)) AS BIGINT)"
