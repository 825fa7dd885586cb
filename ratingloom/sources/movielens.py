"""Delimited rating files in the MovieLens 100k layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_ratings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated user, item, rating, timestamp."""
    return (spark.read.schema("user_id int, item_id int, rating int, ts bigint").option("sep", "\t").csv(path))


def load_users(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated user, age, gender, occupation, zip."""
    return (spark.read.schema("user_id int, age int, gender string, occupation string, zip string")
            .option("sep", "|").csv(path))


def load_genres(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated genre, id; blank lines are dropped."""
    return spark.read.schema("genre string, genre_id int").option("sep", "|").csv(path).dropna(subset=["genre_id"])


def load_occupations(spark: SparkSession, path: str) -> DataFrame:
    """One occupation per line."""
    return spark.read.schema("occupation string").csv(path)
