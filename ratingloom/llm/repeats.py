"""Passages that repeat anywhere in a corpus, found through content-chosen anchors.

A window is ``length`` consecutive symbols (bytes or words). Its anchor is the ``gram`` consecutive symbols
in it with the smallest hash, the leftmost of equal ones: equal windows have equal anchors at the same
place, wherever they stand. Neighbouring windows mostly share their anchor, so a text has one anchor
per (length - gram + 1) / 2 symbols, and its *context* is all that the windows of that anchor cover.

1. Anchors whose hash occurs once in the corpus belong to windows that occur once.
2. Anchors with equal contexts: all their windows repeat. That settles the inside of repeats by hash.
3. What is left are the edges of repeats: contexts that differ, but may share some windows. They are cut
   out of the texts and compared by a local engine in shards of one anchor hash each. A shard with many
   contexts is dealt into parts; windows that are alone in their part meet again by their own hash.

Documents are told apart by doc_id and a text hash; a row that stands twice is two occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm import text as tx
from ratingloom.session import durable

_PLACE = np.uint64((1 << 31) - 1)
#: Contexts that one part of a shard holds at most, on average.
PART_CONTEXTS = 2000
#: Bytes of contexts that an engine looks at together; whole parts only.
ENGINE_BYTES = 1 << 19


@dataclass
class Symbols:
    """The symbols of a batch of texts: hashes, first symbol of each text, and their bytes."""
    data: np.ndarray
    values: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, words: bool) -> Symbols:
        if not words:
            return cls(data, tx._BYTE[data], offsets, None, None)
        starts, ends, first = tx.words(data, offsets)
        return cls(data, tx.bytes_rolling(data).of(starts, ends) | np.uint64(1), first, starts, ends)

    def rolling(self) -> tx.Rolling:
        return tx.Rolling(self.values, "byte" if self.starts is None else "word")

    def cut(self, start: int, end: int) -> bytes:
        """The bytes from symbol ``start`` up to symbol ``end``."""
        if self.starts is None:
            return self.data[start:end].tobytes()
        return self.data[self.starts[start]:self.ends[end - 1]].tobytes()


@dataclass
class Anchors:
    text: np.ndarray  # number of the text
    place: np.ndarray  # first window of the anchor, counted within its text
    shift: np.ndarray  # anchor minus first window
    more: np.ndarray  # last window minus first window
    hash: np.ndarray
    context: np.ndarray


def find_anchors(symbols: Symbols, length: int, gram: int) -> Anchors:
    rolling, first = symbols.rolling(), symbols.first
    grams = rolling.every(gram)
    width = length - gram + 1
    windows = len(symbols.values) - length + 1
    empty = np.zeros(0, np.int64)
    if windows <= 0:
        return Anchors(empty, empty, empty, empty, empty, empty)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(key)] = key
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(since[:windows], upto[width - 1:width - 1 + windows]) & _PLACE).astype(np.int64)
    count = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    anchor = anchor[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(window)) - 1 if len(at) else at
    begin, end, anchor, text = window[at], window[last] + length, anchor[at], text[at]
    shift, more = anchor - begin, window[last] - begin
    context = rolling.of(begin, end) ^ tx.mix((shift * 4096 + more).astype(np.uint64))
    return Anchors(text, begin - first[text], shift, more, grams[anchor].view(np.int64), context.view(np.int64))


def text_hash(text: Column) -> Column:
    return F.hash(F.coalesce(text, F.lit("")))


def _anchor_table(docs: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()),
                        ("place", pa.int64()), ("shift", pa.int32()), ("more", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                a = find_anchors(Symbols.of(*tx.buffers(batch.column("text")), words), length, gram)
                rows = pa.array(a.text)
                yield pa.RecordBatch.from_arrays([
                    pa.array(a.hash), pa.array(a.context), batch.column("doc_id").take(rows), batch.column("th").take(rows),
                    pa.array(a.place), pa.array(a.shift.astype(np.int32)), pa.array(a.more.astype(np.int32))], schema=schema)
    return _keyed(docs).mapInArrow(run, "h long, context long, doc_id long, th int, place long, shift int, more int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("th"), "text")


#: A local engine: texts of contexts -> (spans, windows) with spans (context, start, symbols) that cover what lies
#: in a window found at least twice, and windows (context, start, hash, found at least twice) of all contexts.
Engine = Callable[[list[bytes]], tuple[tuple, tuple]]


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _cut_contexts(docs: DataFrame, requests: DataFrame, length: int, words: bool) -> DataFrame:
    """The texts of the requested contexts."""
    wanted = requests.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "parts", "part", "alone", "place", "more")).alias("r"))
    rows = _keyed(docs).alias("d").join(wanted.alias("w"), _same_document("d", "w")).select("d.*", "w.r")
    schema = pa.schema([("h", pa.int64()), ("parts", pa.int32()), ("part", pa.int32()), ("alone", pa.bool_()),
                        ("doc_id", pa.int64()), ("th", pa.int32()), ("place", pa.int64()), ("more", pa.int32()),
                        ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                symbols = Symbols.of(*tx.buffers(batch.column("text")), words)
                lists = batch.column("r")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                col = {n: flat.field(n) for n in ("h", "parts", "part", "alone", "place", "more")}
                begin = symbols.first[owner] + col["place"].to_numpy()
                end = begin + col["more"].to_numpy() + length
                cut = [symbols.cut(a, b) for a, b in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([
                    col["h"], col["parts"], col["part"], col["alone"], batch.column("doc_id").take(pa.array(owner)),
                    batch.column("th").take(pa.array(owner)), col["place"], col["more"], pa.array(cut, pa.binary())],
                    schema=schema)
    return rows.mapInArrow(run, "h long, parts int, part int, alone boolean, doc_id long, th int, place long, more int, "
                                "text binary")


def _compare(contexts: DataFrame, engine: Engine, length: int) -> DataFrame:
    """Engine results: kind 0 covered spans, 1 windows alone in their part, 2 one of each repeated window.

    Kinds 1 and 2 only for shards of several parts; ``key`` is the window's hash.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()),
                        ("start", pa.int64()), ("size", pa.int64())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        spans, windows = engine(rows.column("text").to_pylist())
        place, alone = rows.column("place").to_numpy(), rows.column("alone").to_numpy(zero_copy_only=False)
        parts = rows.column("parts").to_numpy()
        c, s, n = spans  # context, first symbol, symbols
        mine = alone[c]
        out = [(np.zeros(int(mine.sum()), np.int32), np.zeros(int(mine.sum()), np.int64), c[mine], place[c[mine]] + s[mine], n[mine])]
        c, s, key, repeated = windows
        split = parts[c] > 1
        c, s, key, repeated = c[split], s[split], key[split], repeated[split]
        lone = ~repeated
        out.append((np.ones(int(lone.sum()), np.int32), key[lone], c[lone], place[c[lone]] + s[lone], np.full(int(lone.sum()), length)))
        _, one = np.unique(key[repeated], return_index=True)
        at = np.flatnonzero(repeated)[one]
        out.append((np.full(len(at), 2, np.int32), key[at], c[at], place[c[at]] + s[at], np.full(len(at), length)))
        kind, key, c, start, size = (np.concatenate(x) for x in zip(*out))
        take = pa.array(c)
        flat = rows.combine_chunks()
        pick = lambda name: flat.column(name).take(take).combine_chunks()
        return pa.RecordBatch.from_arrays([
            pa.array(kind), pa.array(key), pick("doc_id"), pick("th"), pa.array(start.astype(np.int64)),
            pa.array(size.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # groups are whole: cut where the shard part changes, keep the open last group
            h, part = batch.column("h").to_numpy(), batch.column("part").to_numpy()
            cut = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1
            edges = [0, *cut.tolist(), batch.num_rows]
            if held and batch.num_rows and (h[0], part[0]) != last:
                edges.insert(0, 0)
            for nr, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if size >= ENGINE_BYTES and (nr or a == b):
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += batch.column("text").slice(a, b - a).nbytes
            if batch.num_rows:
                last = (h[-1], part[-1])
        if held:
            yield solve(pa.Table.from_batches(held))
    return contexts.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(
        run, "kind int, key long, doc_id long, th int, start long, size long")


def repeated_spans(docs: DataFrame, length: int, gram: int, words: bool, engine: Engine) -> DataFrame:
    """doc_id, th, start, size: together these spans cover exactly what lies in a repeated window."""
    anchors = durable(_anchor_table(docs, length, gram, words))
    often = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    hits = durable(anchors.join(often, "h"))
    classes = durable(hits.groupBy("h", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "place", "more")).alias("first")))
    whole = hits.join(classes.filter("n > 1").select("h", "context"), ["h", "context"]).select(
        "doc_id", "th", F.col("place").alias("start"), (F.col("more") + length).cast("long").alias("size"))
    shards = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.max((F.col("n") == 1).cast("int")).alias("open"))
    shards = shards.filter("classes > 1 AND open = 1").select(
        "h", F.ceil(F.col("classes") / PART_CONTEXTS).cast("int").alias("parts"))
    requests = classes.join(shards, "h").select(
        "h", "parts", F.pmod(F.col("context"), F.col("parts")).cast("int").alias("part"), (F.col("n") == 1).alias("alone"), "first.*")
    found = durable(_compare(_cut_contexts(docs, requests, length, words), engine, length))
    twice = found.filter("kind > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    apart = found.filter("kind = 1").join(twice, "key").select("doc_id", "th", "start", "size")
    return whole.unionByName(found.filter("kind = 0").select("doc_id", "th", "start", "size")).unionByName(apart)


def merged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that spans cover together; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + sizes)[order]
    reach = np.maximum.accumulate(b) if len(b) else b
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return a[at], reach[np.append(at[1:], len(a)) - 1] if len(at) else reach


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, spans (array of start and size, null without any) of every row of ``docs``; rows that repeat share one list."""
    lists = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    return _keyed(docs).alias("d").join(lists.alias("s"), _same_document("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")


def span_lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merged runs (starts, ends) of every row of a column of spans."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten()
    start = flat.field("start").to_numpy(zero_copy_only=False)
    size = flat.field("size").to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    for ok, n in zip(valid, np.diff(offsets)):
        n = int(n) if ok else 0
        yield merged(start[at:at + n], size[at:at + n])
        at += n
