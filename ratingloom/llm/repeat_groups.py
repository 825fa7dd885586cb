"""All maximal repeats of a corpus as groups with every occurrence.

A string of at least ``length`` bytes is a maximal repeat if it stands at two places or more and neither the
bytes before its places nor those behind them are all equal. It begins at a repeated window whose places differ
in the byte before. Only the suffixes from such windows, up to the end of their repeated run, are sorted by
(window, bytes); strings of one group share their first window, so each task has whole groups.

A suffix is as long as the rest of its run: a long run with many starts costs their product in bytes, and the
places of one window (without their bytes) have to fit into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm import text as tx
from ratingloom.llm.repeats import repeated_spans, span_lists, with_spans
from ratingloom.llm.suffix_repeats import GRAM, LENGTH, engine, maximal_repeats
from ratingloom.session import durable

#: Places that a task looks at together; whole windows only.
HELD = 50_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list]]:
    """(rows, bytes, offsets, runs of every row) of small batches."""
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            data, offsets = tx.buffers(batch.column("text"))
            yield batch, data, offsets, list(span_lists(batch.column("spans")))


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """row, start, key, left (-1 without a byte before) of every window in a run."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("left", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets, runs in _runs(batches):
            rolling = tx.bytes_rolling(data)
            for row, begin, end, (starts, ends) in zip(batch.column("row").to_pylist(), offsets[:-1], offsets[1:], runs):
                for a, b in zip(starts.tolist(), np.minimum(ends, end - begin).tolist()):
                    at = np.arange(a, b - length + 1)
                    left = np.where(at > 0, data[begin + at - 1].astype(np.int32), -1) if len(at) else at
                    for i in range(0, len(at), 50_000):
                        some = at[i:i + 50_000]
                        yield pa.RecordBatch.from_arrays([
                            pa.repeat(pa.scalar(row, pa.int64()), len(some)), pa.array(some),
                            pa.array(rolling.of(begin + some, begin + some + length).view(np.int64)),
                            pa.array(left[i:i + 50_000].astype(np.int32))], schema=schema)
    return rows.mapInArrow(run, "row long, start long, key long, left int")


def _suffixes(rows: DataFrame, length: int) -> DataFrame:
    """key, left, doc_id, start, suffix of the listed ``starts`` of every row."""
    schema = pa.schema([("key", pa.int64()), ("left", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                        ("suffix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets, runs in _runs(batches):
            rolling, held, size = tx.bytes_rolling(data), [], 0
            for nr, (doc, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("starts").to_pylist())):
                begin, end = int(offsets[nr]), int(offsets[nr + 1])
                starts, ends = runs[nr]
                at = np.array(sorted(wanted), np.int64)
                key = rolling.of(begin + at, begin + at + length).view(np.int64).tolist()
                until = np.minimum(ends[np.searchsorted(starts, at, "right") - 1], end - begin).tolist()
                for k, a, b in zip(key, at.tolist(), until):
                    held.append((k, int(data[begin + a - 1]) if a else -1, doc, a, data[begin + a:begin + b].tobytes()))
                    size += b - a
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    return rows.mapInArrow(run, "key long, left int, doc_id long, start long, suffix binary")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _trees(suffixes: DataFrame, length: int) -> DataFrame:
    """repeat, n_bytes, doc_id, start of every place of every maximal repeat."""
    schema = pa.schema([("repeat", pa.string()), ("n_bytes", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        prefix, left, doc, start, digest = zip(*held)
        prefix = np.array(prefix, np.int64)
        before = np.array(left, np.int64)
        before = np.where(before < 0, -1 - np.arange(len(before)), before)
        doc, start = pa.array(doc, pa.int64()), pa.array(start, pa.int64())
        for depth, lo, hi in maximal_repeats(np.arange(len(prefix)), prefix, before, length):
            name = digest[lo + 1 + int(np.argmin(prefix[lo + 1:hi + 1]))]
            for a in range(lo, hi + 1, 50_000):
                n = min(50_000, hi + 1 - a)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(name), n), pa.repeat(pa.scalar(depth, pa.int64()), n), doc.slice(a, n), start.slice(a, n)],
                    schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, before = [], None, b""
        for batch in batches:
            for key, left, doc, start, suffix in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and len(held) >= HELD:
                    yield from solve(held)
                    held = []
                depth = _common(before, suffix) if key == last else 0
                name = hashlib.blake2b(suffix[:depth], digest_size=16).hexdigest() if depth >= length else ""
                held.append((depth, left, doc, start, name))
                last, before = key, suffix
        if held:
            yield from solve(held)
    return suffixes.repartition("key").sortWithinPartitions("key", "suffix").mapInArrow(
        run, "repeat string, n_bytes long, doc_id long, start long")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """repeat (hash of the string), n_bytes, doc_id, start (byte) of every place of every maximal repeat.

    A place at the start of a text differs from all others in the byte before. Null text is empty text; a row
    that stands twice is two places; rows without doc_id are treated like all others.
    """
    spans = repeated_spans(docs, length, gram, False, lambda texts: engine(texts, length))
    rows = durable(with_spans(docs, spans.distinct()).filter("spans IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    windows = durable(_windows(rows, length))
    # a repeat that all its places continue to the left is part of a longer one
    first = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("left").alias("lo"), F.max("left").alias("hi"))
    first = first.filter("n > 1 AND (lo < hi OR lo < 0)").select("key")
    starts = windows.join(first, "key", "left_semi").groupBy("row").agg(F.collect_list("start").alias("starts"))
    return _trees(_suffixes(rows.join(starts, "row"), length), length)
