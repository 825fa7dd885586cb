from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import empty, frame, texts, words

from ratingloom.llm import near_dedup
from ratingloom.llm.components import components


def shingles(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, part, whole):
    sets = [shingles(t, k) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for (a, _), x in zip(rows, sets):
            for (b, _), y in zip(rows, sets):
                if a is not None and b is not None and label[a] != label[b] and x and y:
                    if whole * len(x & y) >= part * len(x | y):
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
    return Counter((i, len(s), None if i is None else label[i], i is None or label[i] == i)
                   for (i, _), s in zip(rows, sets))


def test_matches_brute_force(spark):
    found = near_dedup.near_duplicates(frame(spark), 3, (85, 100)).collect()
    assert Counter(tuple(r) for r in found) == brute(texts(), 3, 85, 100)


def test_group_of_edited_copies(spark):
    """Most members are too far from the middle, some are near each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[p] = f"x{rng.integers(0, 3)}"
        rows.append((i + 1, " ".join(w)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert Counter(tuple(r) for r in found) == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


@given(st.integers(1, 400), st.integers(0, 2**32))
@settings(max_examples=30, deadline=None)
def test_super_minhash_estimates_similarity(n, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
    share = int(rng.integers(0, n + 1))
    a, b = np.sort(pool[:n]), np.sort(pool[n - share:2 * n - share])
    x, y = near_dedup.super_minhash(a, 200), near_dedup.super_minhash(b, 200)
    assert abs((x == y).mean() - share / (2 * n - share)) < 0.2
    # early stopping changes nothing: every place holds the least value over all ranks of all elements
    assert (near_dedup.super_minhash(np.sort(np.concatenate([a, b])), 200) <= np.minimum(x, y)).all()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(None, 3), (5, 5), (5, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}
