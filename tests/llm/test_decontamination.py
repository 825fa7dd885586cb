import random

import numpy as np
from odd import empty, frame

from ratingloom.llm import decontaminate as dc

ITEMS = "item_id long, text string, score double, doc_id long"


def corpus(seed=11):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    common = vocabulary[:30]
    sentence = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else vocabulary) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(sentence(rng.randint(5, 12)) for _ in range(rng.randint(2, 4)))) for i in range(40)]
    docs = []
    for d in range(120):
        parts = [sentence(rng.randint(8, 15)) for _ in range(rng.randint(3, 40))]
        if d % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), items[d % 40][1].upper() if d % 8 else items[d % 40][1])
        if d % 10 == 1:  # a question without its answer is no leak
            parts.insert(1, items[d % 40][1].rsplit(". ", 1)[0])
        docs.append((d, "\n".join(parts)))
    return docs, items


def bm25(index, terms):
    scores = np.zeros(len(index.ids))
    for t in terms:
        a, b = index.start[t], index.start[t + 1]
        scores[index.items[a:b]] += index.impacts[a:b]
    return scores


def brute(docs, items):
    """Every passage against every item, without index, bounds or skipping."""
    index = dc.build_index(items)
    found = {}
    for d, text in docs:
        terms = dc._terms(text or "")
        step = index.longest
        for a in range(0, max(len(terms) - step, 1), step):
            number = np.unique(dc.term_numbers(index, terms[a:a + 2 * step]))
            scores = bm25(index, number[number >= 0])
            around = terms[max(a - step, 0):a + 3 * step]
            for item in np.flatnonzero(scores >= dc.THRESHOLD - 1e-9):
                q, s = (dc.overlap(around, x[item]) for x in (index.questions, index.answers))
                if q >= dc.QUESTION_SHARE and s >= dc.ANSWER_SHARE:
                    key = d, int(index.ids[item])
                    found[key] = max(found.get(key, (-1,)), (s, q, -a, round(float(scores[item]), 9)))
    return {(*k, *v) for k, v in found.items()}


def test_matches_brute_force(spark):
    docs, items = corpus()
    expect = brute(docs, items)
    for shard_bytes in (1 << 20, 3000):
        rows = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                               spark.createDataFrame([(*i, 0.1, 1) for i in items], ITEMS), shard_bytes=shard_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {e[:2] for e in expect}
        if shard_bytes > 3000:
            assert {(r.doc_id, r.item_id, r.answer_share, r.question_share, -r.first_word, round(r.score, 9)) for r in rows} == expect
    assert {e[0] for e in expect} == {d for d in range(120) if d % 4 == 0}


def test_wand_finds_exactly_the_items_above_the_threshold(monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 3)
    _, items = corpus(3)
    index = dc.build_index(items * 3)
    rng = np.random.default_rng(0)
    for threshold in (0.02, 0.1, 0.3, 0.6):
        for _ in range(30):
            terms = np.unique(rng.integers(0, len(index.vocabulary), 60))
            scores = bm25(index, terms)
            found = dc.block_max_wand(index, terms, threshold)
            assert [i for i, _ in found] == np.flatnonzero(scores >= threshold - 1e-9).tolist()
            assert np.allclose([s for _, s in found], scores[[i for i, _ in found]])


def test_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, None, 0.0, 1), (None, "a b c d", 0.0, 1), (2, "", 0.0, 1), (3, "?!", 0.0, 1), (4, "two words", 0.0, 1),
                                   (4, "two words", 0.0, 1), (5, "idiot", 0.0, 1)], ITEMS)
    docs = frame(spark)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()} == {(10, 4), (23, 5)}
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    none = spark.createDataFrame([], ITEMS)
    assert dc.contaminated(docs, none).count() == 0 and dc.contaminated(empty(spark), items).count() == 0
    assert dc.drop_contaminated(docs, none).count() == docs.count() and dc.drop_contaminated(empty(spark), items).count() == 0
