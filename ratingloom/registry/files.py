"""Readers, on JSON lines and delimited files that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import shown
from ..operators.weights import with_expertise
from ..session import durable, run_folder
from ..sources import movielens, reviews
from ..sources.tables import interactions, review_rows
from .sql import INTER, REVIEWS

ORDER = ["ts", "row_key"]


def _record(rows, *, alias=False):
    """JSON text of each row; absent fields stand for missing values."""
    user, item, rating, ts = ("user_id", "item_id", "rating", "timestamp") if alias else FIELDS4
    return F.to_json(F.struct(
        F.col("user_id").cast("string").alias(user),
        F.when(F.col("item_id") % 11 != 0, F.col("item_id").cast("string")).alias(item),
        F.when(F.col("user_id") % 13 != 0, F.col("rating")).alias(rating),
        F.when(F.col("ts") % 5 != 0, F.col("ts")).alias(ts)))


FIELDS4 = ("reviewerID", "asin", "overall", "unixReviewTime")


def _lines(spark, d):
    """Review lines, written once as a file is: some truncated, some with a null rating, some blank, some lacking fields."""
    rows = interactions(spark, d)
    text = _record(rows)
    nulled = F.regexp_replace(text, '"overall":[0-9.]+', '"overall":null')
    value = (F.when(F.col("item_id") % 19 == 0, F.lit("  "))
             .when(F.col("user_id") % 7 == 0, F.substring(text, 1, 12))
             .when(F.col("user_id") % 17 == 0, nulled).otherwise(text))
    return durable(rows.select(value.alias("value"), "ts", "row_key"))


def _load_reviews(spark, d):
    return reviews.parse_reviews(_lines(spark, d).select("value", "row_key"))


def _load_head(spark, d):
    lines = _lines(spark, d).withColumnRenamed("ts", "pos_ts")
    return reviews.parse_head(lines, 20000, ["pos_ts", "row_key"]).drop("pos_ts")


def _load_hybrid(spark, d):
    rows = review_rows(spark, d)
    value = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("reviewerID"), F.col("item_id").cast("string").alias("asin"),
        F.when(F.col("user_id") % 13 != 0, F.col("rating")).alias("overall"), F.col("text").alias("reviewText"),
        F.when(F.col("helpful")[1] > 0, F.col("helpful")).alias("helpful"),
        F.when(F.col("verified"), F.col("verified")).alias("verified"), F.col("ts").alias("unixReviewTime")))
    lines = rows.select(value.alias("value"), F.struct("ts", "row_key").alias("seq"), "row_key")
    wide = with_expertise(reviews.parse_wide(lines, 500))
    return wide.select("row_key", "user_id", "item_id", "rating", "text", "ts", "verified",
                       shown("helpfulness").alias("helpfulness"), shown("user_expertise").alias("user_expertise"))


def _read_interactions(spark, d):
    rows = interactions(spark, d)
    text = F.when(F.col("user_id") % 2 == 0, _record(rows, alias=True)).otherwise(_record(rows))
    value = F.when(F.col("user_id") % 17 == 0, F.regexp_replace(text, '"(overall|rating)":[0-9.]+', '"$1":"bad"')).otherwise(text)
    return reviews.parse_interactions(rows.select(value.alias("value"), "row_key")).drop("raw_data")


def _read_array_files(spark, d):
    """The records of read_interactions, written as JSON array files of at most 20000 elements and read by byte ranges."""
    rows = row_numbered(interactions(spark, d))
    text = F.when(F.col("user_id") % 2 == 0, _record(rows, alias=True)).otherwise(_record(rows))
    named = F.concat(F.substring(text, 1, F.length(text) - 1), F.lit(',"note":"} ], {","row_key":"'), F.col("row_key"), F.lit('"}'))
    files = rows.withColumn("_v", named).groupBy("part").agg(F.concat(
        F.lit("["), F.array_join(F.collect_list("_v"), ",\n"), F.lit("]")).alias("value"))
    folder = f"{run_folder(spark)}/arrays-{uuid.uuid4().hex}"
    files.write.partitionBy("part").text(folder)
    return reviews.read_interactions(spark, folder, "array").select(
        F.col("raw_data")["row_key"].alias("row_key"), "user_id", "item_id", "rating", "ts")


def row_numbered(rows):
    return reviews.row_chunks(rows, 20_000, ORDER).withColumnRenamed("chunk_id", "part")


def _count(spark, d):
    return reviews.count_records(_lines(spark, d))


def _split_lines(spark, d):
    parts = reviews.number_parts(_lines(spark, d), ORDER, 7000)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_lines"), F.min("row_key").alias("least"), F.max("row_key").alias("greatest"))


def _load_ratings(spark, d):
    folder = f"{run_folder(spark)}/ratings-{uuid.uuid4().hex}"
    rows = interactions(spark, d).select("user_id", "item_id", F.col("rating").cast("int").alias("rating"), "ts")
    rows.write.option("sep", "\t").csv(folder)
    return movielens.load_ratings(spark, folder)


QUERIES = {
    "load_reviews": _load_reviews,
    "load_reviews_head": _load_head,
    "load_hybrid": _load_hybrid,
    "read_interactions": _read_interactions,
    "read_array_files": _read_array_files,
    "count_records": _count,
    "infer_fields": lambda s, d: reviews.infer_fields(_lines(s, d).filter(F.col("value").startswith("{") & F.col("value").endswith("}")), ORDER),
    "row_chunks": lambda s, d: reviews.row_chunks(interactions(s, d).select("ts", "row_key"), 1000, ORDER).select("row_key", "chunk_id"),
    "split_lines": _split_lines,
    "load_ratings": _load_ratings,
}

_PARSED = f"""WITH {INTER},
lines2 AS (SELECT row_key, ts AS pos_ts, item_id % 19 = 0 OR user_id % 7 = 0 AS bad, user_id % 17 = 0 AND user_id % 13 <> 0 AS nulled,
  CAST(user_id AS VARCHAR) AS user_id, CASE WHEN item_id % 11 = 0 THEN 'unknown' ELSE CAST(item_id AS VARCHAR) END AS item_id,
  CASE WHEN user_id % 13 = 0 THEN 1.0 ELSE rating END AS rating, CASE WHEN ts % 5 = 0 THEN 0 ELSE ts END AS ts FROM inter)"""

ORACLES = {
    "load_reviews": f"""{_PARSED} SELECT user_id, item_id, rating, ts, 'Movies_and_TV' AS category, row_key
FROM lines2 WHERE NOT bad AND NOT nulled""",
    "load_reviews_head": f"""{_PARSED}, head AS (SELECT * FROM lines2 ORDER BY pos_ts, row_key LIMIT 20000)
SELECT user_id, item_id, rating, ts, row_key FROM head WHERE NOT bad AND NOT nulled AND item_id <> 'unknown'""",
    "load_hybrid": f"""WITH {REVIEWS},
firsts AS (SELECT user_id, min(row(ts, row_key)) AS f FROM reviews GROUP BY 1 ORDER BY f LIMIT 500),
kept AS (SELECT *, CASE WHEN votes > 0 THEN CAST(ups AS DOUBLE) / votes ELSE 0.5 END AS h FROM reviews
  WHERE user_id IN (SELECT user_id FROM firsts))
SELECT row_key, CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
 CASE WHEN user_id % 13 = 0 THEN 0.0 ELSE rating END AS rating, text, ts, verified, round(h + 1e-10, 6) AS helpfulness,
 round(avg(h) OVER (PARTITION BY user_id) + 1e-10, 6) AS user_expertise FROM kept""",
    "read_interactions": f"""WITH {INTER},
n AS (SELECT *, user_id % 17 = 0 AND user_id % 13 <> 0 AS bad FROM inter)
SELECT row_key, CASE WHEN bad THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS user_id,
 CASE WHEN bad OR item_id % 11 = 0 THEN 'unknown' ELSE CAST(item_id AS VARCHAR) END AS item_id,
 CASE WHEN bad THEN 0.0 WHEN user_id % 13 = 0 THEN 1.0 ELSE rating END AS rating,
 CASE WHEN bad OR ts % 5 = 0 THEN 0 ELSE ts END AS ts FROM n""",
    "read_array_files": f"""WITH {INTER}
SELECT row_key, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN item_id % 11 = 0 THEN 'unknown' ELSE CAST(item_id AS VARCHAR) END AS item_id,
 CASE WHEN user_id % 13 = 0 THEN 1.0 ELSE rating END AS rating, CASE WHEN ts % 5 = 0 THEN 0 ELSE ts END AS ts FROM inter""",
    "count_records": f"WITH {INTER} SELECT count(*) AS n_records FROM inter WHERE item_id % 19 <> 0",
    "infer_fields": f"""WITH {INTER},
head AS (SELECT * FROM inter WHERE item_id % 19 <> 0 AND user_id % 7 <> 0 ORDER BY ts, row_key LIMIT 1),
f AS (SELECT 1 AS o, 'reviewerID' AS field FROM head UNION ALL SELECT 2, 'asin' FROM head WHERE item_id % 11 <> 0
  UNION ALL SELECT 3, 'overall' FROM head WHERE user_id % 13 <> 0 UNION ALL SELECT 4, 'unixReviewTime' FROM head WHERE ts % 5 <> 0)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS pos, field FROM f""",
    "row_chunks": f"WITH {INTER} SELECT row_key, (row_number() OVER (ORDER BY ts, row_key) - 1) // 1000 AS chunk_id FROM inter",
    "split_lines": f"""WITH {INTER},
p AS (SELECT row_key, (row_number() OVER (ORDER BY ts, row_key) - 1) // 7000 AS part FROM inter WHERE item_id % 19 <> 0)
SELECT part, count(*) AS n_lines, min(row_key) AS least, max(row_key) AS greatest FROM p GROUP BY 1""",
    "load_ratings": f"""WITH {INTER} SELECT CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS item_id,
 CAST(rating AS INTEGER) AS rating, ts FROM inter""",
}
