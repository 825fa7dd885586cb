"""Cells of several decays have no column w; the back-fill of an ensemble or sweep counts rows only."""

import pytest
from data import frame

from ratingloom.functions import skew
from ratingloom.operators import recommend as rec
from ratingloom.operators.pairs import neighbor_statistics
from ratingloom.operators.weights import interaction_weight, user_item_cells
from ratingloom.plans import item_based as ib
from ratingloom.session import durable


def test_row_pairs_need_no_weight(spark):
    cells = user_item_cells(interaction_weight(frame(spark)))
    want = {(r["a"], r["b"]): r["cooc"] for r in neighbor_statistics(cells, ("cooc",)).collect()}
    got = neighbor_statistics(cells.withColumnRenamed("w", "w0"), ("cooc",)).collect()
    assert want and {(r["a"], r["b"]): r["cooc"] for r in got} == want


def test_ensemble_of_two_decays_makes_lists(spark):
    df = frame(spark)
    members = ((rec.Settings(k=3), 0.6), (rec.Settings(similarity_method="tanimoto", k=3, time_decay_factor=0.8), 0.4))
    lists = ib.ensemble(df, df, members, 3)
    assert {r["user_id"] for r in lists.collect()} <= {r["user_id"] for r in df.select("user_id").distinct().collect()}
    assert lists.count()


@pytest.mark.parametrize("most", [400_000_000, 150])
def test_settings_share_a_pass_without_writing_its_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(skew.limits, "round_pairs", most)
    df = durable(frame(spark))
    settings = [rec.Settings(k=3, min_similarity=0.2), rec.Settings(similarity_method="jaccard", k=2, use_idf_weighting=False),
                rec.Settings(similarity_method="pearson", k=4, time_decay_factor=0.8, use_idf_weighting=False, min_similarity=0.1)]
    widths = []
    monkeypatch.setattr(ib, "durable", lambda out: widths.append(out.columns) or durable(out))
    for model, s in zip(ib.fit_many(df, settings), settings):
        want, got = (sorted((r["item_id"], r["neighbor"], r["rank"], round(r["sim"], 8)) for r in m.sim.collect())
                     for m in (rec.fit(df, s, minimum_rows=1), model))
        assert want and got == want
    assert not [c for c in widths if "cooc" in c or any(x.startswith("dot_") for x in c)]
