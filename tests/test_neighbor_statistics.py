"""Both directions of item pairs behind one shuffle of packed rows."""

import pytest
from data import frame
from pyspark.sql import functions as F

from ratingloom.operators import similarity as sims
from ratingloom.operators.pairs import neighbor_statistics, pair_statistics
from ratingloom.operators.weights import interaction_weight, user_item_cells


def cells(spark):
    out = user_item_cells(interaction_weight(frame(spark)))
    return out.withColumn("w", F.when(F.col("item_id") == 2, 0.0).otherwise(F.col("w")))


def rounded(rows, columns):
    return sorted(tuple(round(r[c], 9) if r[c] is not None else -1 for c in columns) for r in rows.collect())


@pytest.mark.parametrize("method", sorted(sims.NEEDS))
def test_equals_both_directions_of_the_pairs(spark, tiny_limits, method):
    need = sims.NEEDS[method]
    pairs = pair_statistics(cells(spark), need=need)
    found = neighbor_statistics(cells(spark), need)
    turned = {c: c[:-1] + {"a": "b", "b": "a"}[c[-1]] if c.endswith(("_a", "_b")) else c for c in pairs.columns}
    mirrored = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[F.col(c).alias(turned[c]) for c in pairs.columns[2:]])
    assert found.count() and rounded(found, pairs.columns) == rounded(pairs.unionByName(mirrored), pairs.columns)


def test_pairs_are_not_shuffled_after_they_are_built(spark):
    plan = sims.item_neighbors(cells(spark), "jaccard", 3)._jdf.queryExecution().executedPlan().toString()
    above, built, _ = plan.partition("Generate inline")
    assert built and "Exchange" not in above
