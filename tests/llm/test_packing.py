import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from odd import empty, frame, texts

from ratingloom.llm import packing
from ratingloom.llm.tokens import encoder

PATH = packing.tokenizer_path(packing.VOCABULARY)


@given(st.lists(st.text(alphabet="ab'strevlmd  \n\t1.é²\u0085\xa0’日<|endoftext|>"), max_size=6))
@settings(max_examples=200, deadline=None)
@example(["<|endoftext|> it's", "  x", "\n 's", "a  b", "we'll", "''s", "日本 ab"])
def test_ids_are_the_tokenizers_own(some):
    coder = encoder(PATH)
    ids, offsets = coder.encode(pa.array([*some, None], pa.string()))
    for i, text in enumerate([*some, ""]):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, source, capacity):
    tokenizer = encoder(PATH).tokenizer
    expect = Counter()
    for doc, text in source:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        count = -(-len(ids) // capacity)
        at = 0
        for piece in range(count):
            to = len(ids) - capacity * (count - 1 - piece)
            expect[doc, piece, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at = to
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity,block", [(2048, 8192), (256, 10)])
def test_pieces_and_sequences(spark, capacity, block):
    used, bound = check(packing.pack(frame(spark), capacity, block_pieces=block).collect(), texts(), capacity)
    assert used <= bound + (2 if block > 100 else 12)


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0


def test_genetic_steps_keep_solutions_whole():
    rng = np.random.default_rng(2)
    sizes = rng.integers(300, 1200, 400)
    first = packing.best_fit(sizes, np.argsort(-sizes), 2048)
    other = packing.best_fit(sizes, rng.permutation(400), 2048)
    child = packing.crossover(sizes, first, other, 2048, rng)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= 2048
    grown = packing.evolve(sizes, [other], 2048, rng, generations=60)
    assert len(np.unique(grown[0])) <= len(np.unique(first)) < len(np.unique(other))
    assert packing.fitness(sizes, grown[0], 2048) >= packing.fitness(sizes, first, 2048)


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 5]), np.arange(4), 10).tolist() == [0, 1, 0, 1]
