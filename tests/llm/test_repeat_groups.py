import random
from collections import Counter, defaultdict

import pytest

from ratingloom.llm import repeat_groups, repeats


def naive(texts, least):
    """Counter of (frozen places) of all maximal repeats over all texts, by growing strings."""
    out = {}
    for size in range(least, max(map(len, texts)) + 1):
        at = defaultdict(list)
        for doc, t in enumerate(texts):
            for i in range(len(t) - size + 1):
                at[t[i:i + size]].append((doc, i))
        for s, places in at.items():
            left = {texts[d][i - 1] if i else (d, "start") for d, i in places}
            right = {texts[d][i + size] if i + size < len(texts[d]) else (d, "end") for d, i in places}
            if len(places) > 1 and len(left) > 1 and len(right) > 1:
                out[s] = sorted(places)
    return out


@pytest.mark.parametrize("part", [2000, 2])
def test_groups_are_all_maximal_repeats_with_all_places(spark, monkeypatch, part):
    """Repeats far longer than a context, nested ones, copies of a text, and one passage in many texts."""
    monkeypatch.setattr(repeats, "PART_CONTEXTS", part)
    monkeypatch.setattr(repeat_groups, "HELD", part)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, other = noise(90), noise(25)
    texts = [noise(rng.randint(0, 30)) + passage[:rng.randint(40, 90)] + noise(rng.randint(0, 20)) for _ in range(12)]
    texts += [passage, passage, other + passage[30:] + other, "ab" * 20, "", noise(10), noise(5) + other]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = defaultdict(list)
    for r in repeat_groups.repeat_groups(frame, 12, 4).collect():
        found[r.repeat, texts[r.doc_id][r.start:r.start + r.n_bytes]].append((r.doc_id, r.start))
    assert len({name for name, _ in found}) == len(found)
    assert {s: sorted(places) for (_, s), places in found.items()} == naive(texts, 12)


def test_repeated_rows_and_spans(spark):
    """A row that stands twice is two places; the places together cover what op6 removes."""
    text = "the quick brown fox jumps over"
    rows = [(1, text), (1, text), (2, "x" + text[4:] + "y"), (3, None), (None, text)]
    got = repeat_groups.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).collect()
    assert Counter((r.doc_id, r.start, r.n_bytes) for r in got) == Counter(
        {(1, 0, 30): 2, (None, 0, 30): 1, (1, 4, 26): 2, (None, 4, 26): 1, (2, 1, 26): 1})
