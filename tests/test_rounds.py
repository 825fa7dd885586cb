"""Pairs and candidates of which few are kept are made in rounds; a step's shuffle files go with it."""

import time

import pytest
from data import frame
from pyspark.sql import functions as F

from ratingloom.functions import skew
from ratingloom.operators import pairs as prs
from ratingloom.operators import recommend as rec
from ratingloom.operators import similarity as sims
from ratingloom.operators.weights import interaction_weight, item_idf, user_item_cells
from ratingloom.session import FREE_SHUFFLES, durable


def cells_of(spark):
    return durable(user_item_cells(interaction_weight(frame(spark))))


def written(monkeypatch, module):
    """Counts what a module writes."""
    seen = []
    monkeypatch.setattr(module, "durable", lambda df: seen.append(df) or durable(df))
    return seen


@pytest.mark.parametrize("heavy", [4, 200_000])
@pytest.mark.parametrize("method", ["enhanced_cosine", "pearson"])
def test_neighbors_in_rounds(spark, monkeypatch, method, heavy):
    cells = cells_of(spark)
    idf = item_idf(cells) if method == "enhanced_cosine" else None
    monkeypatch.setattr(skew.limits, "heavy_rows", heavy)
    want = sorted(sims.item_neighbors(cells, method, 3, idf=idf).collect())
    steps = written(monkeypatch, prs)
    monkeypatch.setattr(skew.limits, "round_pairs", 60)
    got = sims.item_neighbors(cells, method, 3, idf=idf)
    assert want and sorted(got.collect()) == want and len(steps) > 5
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_lists_in_rounds(spark, monkeypatch):
    df = frame(spark)
    settings = rec.Settings(similarity_method="jaccard", k=2, use_idf_weighting=False)
    order = ["user_id", "rank"]
    want = rec.recommend(rec.fit(df, settings), df, 3).orderBy(*order).collect()
    steps = written(monkeypatch, rec)
    monkeypatch.setattr(skew.limits, "round_pairs", 40)
    got = rec.recommend(rec.fit(df, settings), df, 3).orderBy(*order).collect()
    assert want and got == want and len(steps) > 8


@pytest.mark.parametrize("ids, sim", [((1, 1 << 40), 0.5), ((1, 2), 3.5), ((1, 2), 1 / 3), ((1, 2), 0.123456789)])
def test_packed_neighbors_lose_nothing(spark, ids, sim):
    table = spark.createDataFrame([(ids[0], ids[1], sim), (ids[1], ids[0], 0.25)], "item_id bigint, neighbor bigint, sim double")
    history = spark.createDataFrame([(7, ids[0], 1.0, True)], "user_id bigint, item_id bigint, weight double, recent boolean")
    assert [tuple(r) for r in rec.scored_candidates(history, table).collect()] == [(7, ids[1], sim, sim)]


def test_shuffle_files_of_a_written_step_are_deleted(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().endswith(".data")}

    before, setting = files(), spark.conf.get(FREE_SHUFFLES, None)
    out = durable(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count().repartition(5))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 97
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
