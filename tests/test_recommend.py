"""The item-based recommender against a dense restatement of its formulas."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from data import frame, interactions
from ratingloom.operators import popularity as pops
from ratingloom.operators import recommend as rec
from ratingloom.operators import similarity as sims
from ratingloom.operators.weights import interaction_weight, item_idf, user_item_cells
from ratingloom.plans import item_based as ib

ROWS = interactions(rows=90)


def dense(rows, decay=0.95):
    newest = max(r[3] for r in rows)
    users, items = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    m, n = np.zeros((len(users), len(items))), np.zeros((len(users), len(items)))
    for u, i, _, ts, _ in rows:
        m[users.index(u), items.index(i)] += decay ** ((newest - ts) // 86400 / 365)
        n[users.index(u), items.index(i)] += 1
    return users, items, m, n


def expected(rows, method, use_idf, k, floor=1e-4):
    users, items, m, n = dense(rows)
    cooc, big = n.T @ n, len(users)
    out = {}
    for a in range(len(items)):
        sims_ = []
        for b in range(len(items)):
            if a == b:
                continue
            x, y = m[:, a], m[:, b]
            if method == "enhanced_cosine":
                s = x @ y / np.linalg.norm(x) / np.linalg.norm(y) * (1 + cooc[a, b] / 100)
                s *= math.log(big / (1 + (x > 0).sum())) if use_idf else 1
            elif method == "jaccard":
                both = ((x > 0) & (y > 0)).sum()
                s = both / ((x > 0) | (y > 0)).sum() * (1 + cooc[a, b] / 100)
            elif method == "tanimoto":
                s = x @ y / (x @ x + y @ y - x @ y)
            else:
                cx, cy = x - x.mean(), y - y.mean()
                d = np.linalg.norm(cx) * np.linalg.norm(cy)
                s = cx @ cy / d if d > 0 else 0
            if s > floor:
                sims_.append((items[b], s))
        out[items[a]] = sorted(sims_, key=lambda t: (-round(t[1], 9), t[0]))[:k]
    return out


@pytest.mark.parametrize("method", list(sims.NEEDS))
def test_similarity_matches_the_dense_formula(spark, tiny_limits, method):
    cells = user_item_cells(interaction_weight(frame(spark, ROWS)))
    idf = item_idf(cells) if method == "enhanced_cosine" else None
    got = defaultdict(list)
    for r in sims.item_neighbors(cells, method, 4, idf=idf).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["neighbor"], r["sim"]))
    want = expected(ROWS, method, idf is not None, 4)
    for item, pairs in want.items():
        assert [p[0] for p in got[item]] == [p[0] for p in pairs]
        assert np.allclose([p[1] for p in got[item]], [p[1] for p in pairs], atol=1e-8)


def test_unknown_method_and_negative_threshold(spark):
    assert sims.resolve_method("nonsense") == "enhanced_cosine"
    with pytest.raises(ValueError):
        sims.neighbors_from_pairs(None, min_similarity=-1)


def reference_lists(rows, top_n, k, diversity=0.2, popw=0.2, decay=0.95):
    users, items, m, n = dense(rows)
    sim = expected(rows, "jaccard", False, k)
    cooc = defaultdict(Counter)
    newest = max(r[3] for r in rows)
    hist = defaultdict(list)
    for u, i, _, ts, key in sorted(rows, key=lambda r: (r[3], r[4])):
        hist[u].append(i)
    for seq in hist.values():
        for x in range(len(seq)):
            for y in range(x + 1, len(seq)):
                cooc[seq[x]][seq[y]] += 1
                cooc[seq[y]][seq[x]] += 1
    pop = Counter()
    for _, i, _, ts, _ in rows:
        pop[i] += decay ** ((newest - ts) // 86400 / 365) / len(rows)
    out = {}
    for u, seq in hist.items():
        w = [decay ** j for j in range(len(seq) - 1, -1, -1)]
        total, score, seen = sum(w), defaultdict(float), set(seq)
        for pos, i in enumerate(seq):
            for j, s in sim[i]:
                if j not in seen:
                    score[j] += s * w[pos] / total
        if len(score) < 2 * top_n:
            for i in seq[-5:]:
                for j, c in sorted(cooc[i].items(), key=lambda t: (-t[1], t[0]))[:20]:
                    if j not in seen and j not in score:
                        score[j] = c / 100
        latest = []
        for i in reversed(seq):
            if i not in latest:
                latest.append(i)
        final = {}
        for j, s in score.items():
            near = max([x for i in latest[:10] for y, x in sim[i] if y == j], default=0)
            final[j] = (s + pop[j] * popw) * (1 - diversity * near)
        out[u] = sorted(final.items(), key=lambda t: (-round(t[1], 9), t[0]))[:top_n]
    return out, pop


@pytest.mark.parametrize("k,top_n", [(2, 3), (4, 2)])
def test_recommendations_match_a_loop(spark, tiny_limits, k, top_n):
    df = frame(spark, ROWS)
    model = rec.fit(df, rec.Settings(similarity_method="jaccard", k=k, use_idf_weighting=False))
    got = defaultdict(list)
    for r in rec.recommend(model, df, top_n).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append((r["item_id"], r["score"]))
    want, _ = reference_lists(ROWS, top_n, k)
    for user, pairs in want.items():
        if pairs:
            assert [p[0] for p in got[user]] == [p[0] for p in pairs]
            assert np.allclose([p[1] for p in got[user]], [p[1] for p in pairs], atol=1e-7)


def test_users_without_history_get_popular_items(spark):
    df = frame(spark, ROWS)
    model = rec.fit(df, rec.Settings(use_idf_weighting=False))
    stranger = spark.createDataFrame([(99,)], "user_id bigint")
    got = rec.recommend(model, df, 2, users=stranger).filter("user_id = 99").orderBy("rank").collect()
    top = pops.popular_items(model.popularity).orderBy("rank").limit(2).collect()
    assert [r["item_id"] for r in got] == [r["item_id"] for r in top]


def test_cooccurrence_counts_row_pairs(spark, tiny_limits):
    cells = user_item_cells(interaction_weight(frame(spark, ROWS)))
    got = {(r["item_id"], r["neighbor"]): r["n"] for r in sims.cooccurrence(cells).collect()}
    want = Counter()
    by_user = defaultdict(list)
    for r in ROWS:
        by_user[r[0]].append(r[1])
    for seq in by_user.values():
        for x in range(len(seq)):
            for y in range(x + 1, len(seq)):
                want[seq[x], seq[y]] += 1
                want[seq[y], seq[x]] += 1
    assert got == dict(want)


def test_unusable_time_weighs_one_in_the_matrix_and_zero_in_popularity(spark):
    rows = [(1, 1, 5.0, 1_000_000_000, "a"), (2, 1, 5.0, None, "b"), (1, 2, 5.0, None, "c")]
    df = frame(spark, rows)
    w = {r["row_key"]: r["w"] for r in interaction_weight(df).collect()}
    assert w == {"a": 1.0, "b": 1.0, "c": 1.0}
    pop = {r["item_id"]: r["pop"] for r in pops.item_popularity(df).collect()}
    assert pop[2] == 0.0 and abs(pop[1] - 1 / 3) < 1e-9


def test_model_files_round_trip(spark, tmp_path):
    df = frame(spark, ROWS)
    model = rec.fit(df, rec.Settings(k=3, popularity_weight=0.4, use_idf_weighting=False))
    ib.save_model(model, str(tmp_path / "m"))
    back = ib.load_model(spark, str(tmp_path / "m"))
    assert back.settings == model.settings
    one = sorted(map(tuple, rec.recommend(model, df, 3).collect()))
    assert sorted(map(tuple, rec.recommend(back, df, 3).collect())) == one


def test_fit_many_equals_single_fits(spark):
    df = frame(spark, ROWS)
    settings = [rec.Settings(name="a", k=3), rec.Settings(name="b", similarity_method="pearson", k=3, time_decay_factor=0.8)]
    for model, s in zip(ib.fit_many(df, settings), settings):
        assert sorted(map(tuple, model.sim.collect())) == sorted(map(tuple, rec.fit(df, s).sim.collect()))
