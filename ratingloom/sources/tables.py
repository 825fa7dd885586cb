"""Canonical interaction views over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Zone-less timestamp to epoch seconds, independent of the session time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def _line_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ts = epoch_seconds(F.col("l_shipdate"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).alias("rating"),
        ts.alias("ts"),
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey",
            F.col("l_quantity").cast("bigint"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint"), ts,
        ).alias("row_key"),
        F.round(F.col("l_tax") * 100).cast("int").alias("votes"),
        F.round(F.col("l_discount") * 100).cast("int").alias("ups"),
        (F.col("l_returnflag") == "N").alias("verified"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating, ts, row_key; (ts, row_key) is the total row order."""
    return _line_view(spark, sf_dir).select("user_id", "item_id", "rating", "ts", "row_key")


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with helpful votes, verified flag and an item text."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"),
    )
    rows = _line_view(spark, sf_dir)
    return rows.join(parts, "item_id").select(
        "user_id", "item_id", "rating", "text", "ts",
        F.array(F.least("ups", "votes"), F.col("votes")).alias("helpful"),
        "verified", "row_key",
    )


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions: the item is the event's k property, few and heavily shared."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        (F.lit(1.0) + F.pmod(F.floor("value"), F.lit(5))).alias("rating"),
        epoch_seconds(F.col("ts")).alias("ts"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("row_key"),
        F.col("value").alias("weight"),
        F.col("event_type"),
    )
