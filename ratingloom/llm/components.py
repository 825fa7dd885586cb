"""Connected components of a link table, as a fixpoint of joins (large-star / small-star rounds)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import durable


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over each batch: the same components with at most one link per node.

    Batches are bounded by Spark, so is the memory; what is left is a spanning forest.
    """
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, columns=["a", "b"], dtype="int64")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); component is its smallest node.

    Nodes with many links: minima are aggregated map-side, and the joins on a node are plain
    equi-joins that the adaptive skew handling splits. Null ends are ignored; an empty table gives
    no rows. Every round writes its links, so a lost executor costs a re-read.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    state = durable(links.mapInPandas(_forest, "a long, b long").filter("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above a node go to its smallest neighbour
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        # small star: a node and its neighbours below go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        state = durable(small.filter("a <> b").distinct())
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links did not settle")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
