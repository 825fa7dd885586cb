import hashlib
from collections import Counter

import numpy as np
import pytest
from odd import empty, frame, texts, words

from ratingloom.llm import phrase_automata, repeats, suffix_repeats


def brute(rows, length, as_words):
    """Per row: symbols, flags of the repeated ones."""
    symbols = [words(t) if as_words else list((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(s[i:i + length]) for s in symbols for i in range(len(s) - length + 1))
    out = []
    for s in symbols:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((s, gone))
    return out


@pytest.fixture(params=[2000, 2])
def parts(request, monkeypatch):
    """The second value deals every shard into parts, the third path of the module."""
    monkeypatch.setattr(repeats, "PART_CONTEXTS", request.param)
    monkeypatch.setattr(repeats, "ENGINE_BYTES", 1000 if request.param == 2 else 1 << 19)


def test_bytes_match_brute_force(spark, parts):
    expect = Counter()
    for (doc, _), (s, gone) in zip(texts(), brute(texts(), 60, False)):
        kept = bytes(x for x, g in zip(s, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        expect[doc, len(s), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    rows = suffix_repeats.remove_repeats(frame(spark), 60, 20).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == expect
    assert any(r.n_removed for r in rows) and all(len(r.kept) == r.n_bytes - r.n_removed for r in rows)


def test_words_match_brute_force(spark, parts):
    expect = Counter()
    for (doc, _), (s, gone) in zip(texts(), brute(texts(), 12, True)):
        kept = " ".join(x for x, g in zip(s, gone) if not g)
        expect[doc, len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    rows = phrase_automata.remove_repeated_phrases(frame(spark), 12, 4).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == expect


def test_empty_table(spark):
    assert suffix_repeats.remove_repeats(empty(spark)).count() == 0
    assert phrase_automata.remove_repeated_phrases(empty(spark)).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 101, 300, dtype=np.uint8)
    texts_ = [np.concatenate([rng.integers(97, 123, n, dtype=np.uint8), shared, rng.integers(97, 123, n, dtype=np.uint8)])
              for n in (0, 7, 311)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts_])))
    found = repeats.find_anchors(repeats.Symbols.of(np.concatenate(texts_), offsets, False), 50, 16)
    inside = []
    for nr, n in enumerate((0, 7, 311)):
        mine = found.text == nr
        # every window has exactly one anchor
        assert (found.more[mine] + 1).sum() == len(texts_[nr]) - 49
        places = {}
        for p, s, m, h in zip(found.place[mine], found.shift[mine], found.more[mine], found.hash[mine]):
            places |= {int(w) - n: (int(p + s) - n, int(h)) for w in range(p, p + m + 1)}
        inside.append([places[w] for w in range(251)])
    assert inside[0] == inside[1] == inside[2]


def naive_maximal_repeats(text: bytes, least: int):
    """{(string, places)} of all maximal repeats of at least ``least`` bytes."""
    out = set()
    for size in range(least, len(text)):
        at = {}
        for i in range(len(text) - size + 1):
            at.setdefault(text[i:i + size], []).append(i)
        for s, places in at.items():
            if len(places) > 1:
                left = {text[i - 1:i] if i else None for i in places}
                right = {text[i + size:i + size + 1] if i + size < len(text) else None for i in places}
                if len(left) > 1 and len(right) > 1:
                    out.add((s, tuple(places)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_interval_tree_gives_all_maximal_repeats(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 2 + seed % 3, 70, dtype=np.uint8)
    ends = np.full(70, 70)
    order, steps = suffix_repeats.suffix_array(text, ends, 128)
    raw = text.tobytes()
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(70))
    prefix = suffix_repeats.common_prefixes(order, steps, text, ends)
    left = np.concatenate(([-1], text[:-1].astype(int)))
    found = {(raw[order[lo]:order[lo] + depth], tuple(sorted(order[lo:hi + 1].tolist())))
             for depth, lo, hi in suffix_repeats.maximal_repeats(order, prefix, left, 3)}
    assert found == naive_maximal_repeats(raw, 3)


def test_automaton_finds_overlapping_passages():
    machine = phrase_automata.automaton([(1, 2, 1), (2, 1, 2)])
    assert [(end, nr) for end, nr in machine.iter((1, 2, 1, 2, 1))] == [(2, 0), (3, 1), (4, 0)]


def edge_cases(seed):
    """Contexts that are equal for longer than a power of two, and ones that end where others go on with zero bytes."""
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 123, 336, dtype=np.uint8)
    near = []
    for at in (331, 258, 331, 290):
        near.append(base.copy())
        near[-1][at] = 65 + len(near)
    cut = int(rng.integers(210, 280))
    raw = rng.integers(97, 123, 300, dtype=np.uint8).tobytes()
    zero = [raw[:cut], raw[:cut] + b"\0" * 3 + raw[cut:], raw[:cut] + b"\0" * 2 + raw[cut:], raw[:cut] + b"\0" * 3 + raw[cut:] + b"q"]
    return [[t.tobytes() for t in near], zero]


@pytest.mark.parametrize("seed", range(8))
def test_engine_covers_all_repeated_windows(seed):
    for contexts in edge_cases(seed):
        rows = [(None, t.decode("latin-1")) for t in contexts]
        (owner, start, size), _ = suffix_repeats.engine(contexts, 200)
        found = [[False] * len(t) for t in contexts]
        for o, a, n in zip(owner, start, size):
            found[o][a:a + n] = [True] * n
        assert found == [gone for _, gone in brute(rows, 200, False)]


def test_whole_rows_match_brute_force_at_full_length(spark):
    rows = [(nr, t.decode()) for nr, t in enumerate(t for seed in range(6) for case in edge_cases(seed) for t in case)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_repeats.remove_repeats(docs).collect()}
    assert found == {doc: (sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)))
                     for (doc, _), (_, gone) in zip(rows, brute(rows, 200, False))}
