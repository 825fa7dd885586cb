import hashlib
import math
import random

import numpy as np
import pytest

from ratingloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, error long, codes string, vec string, id long"


def brute(rows, parts, entries, rounds):
    """{row number: (code, error)} and the final codebooks, with Python's integers."""
    kept = [(n, i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for n, (i, v, _) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for *_, v in kept] + [1]) // parts) * parts
    kept = [(n, i, v + [0] * (width - len(v))) for n, i, v in kept]
    size = width // parts
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[v[p * size:(p + 1) * size] for *_, v in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        found = {n: [min((gap(v[p * size:(p + 1) * size], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
                 for n, _, v in kept}
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[p * size:(p + 1) * size] for n, _, v in kept if found[n][p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return {n: ("".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for n, x in found.items()}, books


def vectors(width=10):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[6][1], 2), (None, None, 1), (200, None, 1)]
    rows += [(201, [0.1, None], 1), (202, [float("nan")] * width, 1), (203, [float("inf")] + [0.0] * (width - 1), 2)]
    return rows + [(204, [], 2), (205, [0.5] * 3, None), (206, [-0.0] * width, 7), (-4, rows[7][1], 1)]


@pytest.mark.parametrize("parts, entries, rounds, extra", [(4, 8, 2, []), (16, 64, 2, []), (2, 256, 1, []), (3, 5, 2, [(300, [1e12] * 10, 3), (301, [-3e30] + [1.0] * 9, 3)])])
def test_codes_match_brute_force(spark, parts, entries, rounds, extra):
    rows = vectors() + extra
    df = spark.createDataFrame([(*r, 7, "c", "v", 9) for r in rows], SCHEMA).repartition(3)
    coded, books = vc.compress(df, parts=parts, entries=entries, rounds=rounds)
    expect, entries_ = brute(rows, parts, entries, rounds)
    assert [e.tolist() for e in books.entries] == entries_
    text = ",".join(str(x) for b in entries_ for e in b for x in e)
    assert books.digest() == hashlib.sha256(text.encode()).hexdigest()
    most = (1 << 63) - 1
    wanted = sorted((str(rows[n][0]), str(rows[n][2]), code, min(error, most)) for n, (code, error) in expect.items())
    got = vc.label_errors(coded).collect()
    assert sorted((str(r.id), str(r.label), bytes(r.codes).hex(), r.error) for r in got) == wanted
    for label in {str(r[2]) for r in rows}:
        total = min(sum(w[3] for w in wanted if w[1] == label), most)
        assert all(r.label_error == total for r in got if str(r.label) == label)


def test_transform_scales_distances():
    m = vc.sequency_hadamard(8)
    assert (m @ m.T == 8 * np.eye(8, dtype=int)).all()
    assert (np.diff(m, axis=1) != 0).sum(axis=1).tolist() == list(range(8))
    rng = np.random.default_rng(1)
    a, b = rng.integers(-500, 500, (40, 5)), rng.integers(-500, 500, (9, 5))
    b[3] = b[1]  # a tie goes to the lower number
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    entry, error = vc.nearest(vc.transformed(a), vc.transformed(b))
    assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 1), (2, [None], 1)]):
        df = spark.createDataFrame([(*r, 7, "c", "v", 9) for r in rows], SCHEMA)
        coded, books = vc.compress(df)
        assert vc.label_errors(coded).count() == 0
        assert books.digest() == hashlib.sha256(b"").hexdigest()
