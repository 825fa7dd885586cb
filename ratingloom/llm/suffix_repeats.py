"""Suffix-array deduplication: maximal repeats by the common-prefix interval tree.

The edges of repeats (see repeats) are compared with an enhanced suffix array over all their contexts:
suffixes sorted by prefix doubling, common prefixes of neighbours from the ranks of the doubling steps. A
stack scan turns them into the tree of common-prefix intervals; an interval of at least ``length`` bytes is a
maximal repeat if the bytes on the left of its suffixes differ, or one has none. Each such interval is a
group with all its occurrences among these contexts; repeat_groups lists the groups of the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm import text as tx
from ratingloom.llm.repeats import repeated_spans, span_lists, with_spans

LENGTH, GRAM = 200, 64


def suffix_array(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order of all suffixes by at least ``least`` bytes, ranks per doubling step).

    ``ends``: for every place the end of its text; suffixes never read past it, and one that ends is smaller than one
    that goes on with a zero byte. A step only sorts suffixes that are still equal to another.
    """
    n = len(data)
    place = np.arange(n)
    padded = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(8) | np.where(place + i < ends, padded[i:n + i], np.uint64(0))
    key = key << np.uint64(8) | np.minimum(ends - place, 7).astype(np.uint64)
    _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(count[rank] > 1)
    rank = (np.cumsum(count) - count)[rank]
    steps, size = [(7, rank)], 7
    while size < least and len(tied):
        nxt = np.where(tied + size < ends[tied], rank[np.minimum(tied + size, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        before = rank[tied]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], before[1:] != before[:-1]))
        at = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = before + np.maximum.accumulate(at * fresh) - np.maximum.accumulate(at * group)
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        size *= 2
        steps.append((size, rank))
    return np.argsort(rank, kind="stable"), steps


def common_prefixes(order: np.ndarray, steps: list[tuple[int, np.ndarray]], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every suffix in ``order`` and the one before it (0 for the first)."""
    if not len(order):
        return np.zeros(0, np.int64)
    a, b = order[:-1], order[1:]
    room = np.minimum(ends[a] - a, ends[b] - b)
    got = np.zeros(len(a), np.int64)
    last = len(data) - 1
    for size, rank in reversed(steps):
        for _ in range(2 if size == steps[-1][0] else 1):
            x, y = np.minimum(a + got, last), np.minimum(b + got, last)
            got += size * ((got + size <= room) & (rank[x] == rank[y]))
    for _ in range(steps[0][0] - 1):
        x, y = np.minimum(a + got, last), np.minimum(b + got, last)
        got += (got < room) & (data[x] == data[y])
    return np.concatenate(([0], got))


def maximal_repeats(order: np.ndarray, prefix: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of ``order`` that are maximal repeats, parents later.

    ``left``: the byte before each place, or a negative number of its own for places without one.
    """
    before = left[order]
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))) if len(order) else np.zeros(0, int)
    found, stack = [], []
    deep = np.flatnonzero(prefix >= least)
    if not len(deep):
        return found
    # the scan only stops at places where a deep interval goes on, and once behind each
    at = 0
    places = deep.tolist()
    values = prefix[deep].tolist()
    while at < len(places):
        first = at
        while at + 1 < len(places) and places[at + 1] == places[at] + 1:
            at += 1
        for i in range(first, at + 2):  # one step past the run closes all intervals
            depth = values[i] if i <= at else 0
            here = places[first] + (i - first)
            low = here - 1
            while stack and stack[-1][0] > depth:
                top, low = stack.pop()
                if changes[here - 1] != changes[low]:
                    found.append((top, low, here - 1))
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, low))
        at += 1
    return found


def engine(texts: list[bytes], length: int = LENGTH):
    """Spans and windows of contexts (see repeats): what lies in a window found in two places."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = first[owner + 1]
    # sorted to the end of the longest context: the tree needs whole common prefixes, else an interval that is left out
    # for its equal left bytes may reach further than the one that stands for it
    order, steps = suffix_array(data, ends, max(length, int(sizes.max(initial=0))))
    windows = np.arange(len(data)) + length <= ends
    order = order[windows[order]]
    prefix = common_prefixes(order, steps, data, ends)
    left = np.concatenate(([0], data[:-1].astype(np.int64))) if len(data) else np.zeros(0, np.int64)
    left[first[:-1]] = -1 - np.arange(len(texts))
    cover = np.zeros(len(data), np.int64)
    for depth, lo, hi in sorted(maximal_repeats(order, prefix, left, length)):
        cover[order[lo:hi + 1]] = depth
    at = np.flatnonzero(cover)
    spans = (owner[at], at - first[owner[at]], cover[at])
    deep = prefix >= length
    again = deep.copy()
    again[:-1] |= deep[1:]
    key = tx.bytes_rolling(data).of(order, order + length).view(np.int64) if len(order) else np.zeros(0, np.int64)
    return spans, (owner[order], order - first[owner[order]], key, again)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of every row.

    Removed are all bytes in a string of ``length`` bytes that also starts at another place of any text.
    Null text is empty text; a row that stands twice is two occurrences; texts below ``length`` bytes and
    rows without doc_id are treated like all others. Extra columns are ignored; an empty table gives none.
    """
    spans = repeated_spans(docs, length, gram, False, lambda texts: engine(texts, length))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                data, offsets = tx.buffers(batch.column("text"))
                out = []
                for (starts, ends), a, b in zip(span_lists(batch.column("spans")), offsets[:-1], offsets[1:]):
                    raw = data[a:b].tobytes()
                    edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    out.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(
                    pa.array(c, t) for c, t in zip(zip(*out), schema.types[1:]))], schema=schema)
    return with_spans(docs, spans).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
