import math
import re
from collections import Counter

import numpy as np
import pytest
from odd import empty, frame, texts

from ratingloom.llm import lexical_search as ls

ITEMS = "item_id long, text string, doc_id long, score double, term string"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, best):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    frequency = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        rows = []
        for (doc, c), size in zip(counts, sizes):
            m = 75 + 25 * size * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out, key=str)


def questions():
    t = dict(texts())
    return [(1, t[12][:200]), (2, "Idiot é ñ? ONE two,one"), (2, "Idiot é ñ? ONE two,one"), (3, t[21][:40]), (4, ""), (5, None),
            (6, "... ???"), (7, "absentterm"), (None, t[18][300:600]), (8, t[18]), (9, "aaaa AAAA a\x00b"), (9, "words")]


@pytest.mark.parametrize("best, limit", [(20, 8 << 20), (2, 700)])
def test_matches_brute_force(spark, best, limit):
    items = spark.createDataFrame([(*q, 5, 0.5, "t") for q in questions()], ITEMS).repartition(2)
    rows = ls.search(frame(spark), items, best, limit)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    expect = brute(texts(), [q for q in questions() if q[1] is not None], best)
    assert sorted(map(tuple, rows.collect()), key=str) == expect and expect


def test_empty_tables(spark):
    items = spark.createDataFrame([(*q, 5, 0.5, "t") for q in questions()], ITEMS)
    assert ls.search(empty(spark), items).count() == 0
    assert ls.search(frame(spark), items.filter("false")).count() == 0
    assert ls.search(frame(spark), items.filter("item_id IN (4, 5, 6)")).count() == 0


def test_counts_and_large_norms():
    data = "Ab c-d é1 x ".encode()
    offsets = np.array([0, 0, 6, len(data)])
    counts, row, term, times = ls.ItemTerms([(1, "d D ab e é1")]).find(np.frombuffer(data, np.uint8), offsets)
    assert counts.tolist() == [0, 3, 2]
    assert sorted(zip(row.tolist(), term.tolist(), times.tolist())) == [(1, 0, 1), (1, 1, 1), (2, 3, 1)]
    assert ls.length_norms(np.array([1 << 40]), 1 << 40, 1 << 45).tolist() == [75 + 25 * (1 << 35)]


def test_candidates_stay_bounded():
    rng = np.random.default_rng(2)
    kept, every = ls._Best(3, 4), []
    for step in range(50):
        scores = rng.integers(0, 6, (10, 3))
        ids = rng.permutation(10) + 10 * step
        kept.add(scores, ids, np.zeros(10, bool))
        every += [(i, -int(s), int(d)) for row, d in zip(scores, ids) for i, s in enumerate(row) if s > 0]
        assert len(kept.rows[0]) <= 12
    expect = [x for i in range(3) for x in sorted(e for e in every if e[0] == i)[:4]]
    assert sorted(zip(kept.rows[0].tolist(), (-kept.rows[1]).tolist(), kept.rows[3].tolist())) == sorted(expect)
