"""JSON array files of any size, read by byte ranges: every split of a file is its own task.

Spark's text reader cuts a file at each ``{``, a byte that no complete JSON file ends with and that is never escaped, so the
cuts need no knowledge of what stands before them. The fragments are packed into chunks. Whether a chunk starts inside a
string, and how deep in brackets, follows from running sums over one small row per chunk; with that, a chunk is cut into
the elements of the array. Only the elements that cross a chunk's border are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable

#: Bytes of a chunk, about; a fragment (the text from one { to the next) is never cut.
CHUNK_BYTES = 1 << 20

_CHUNK = ("file string, block long, nr long, data binary, quotes long, rise0 long, rise1 long, low0 long, low1 long, "
          "is_array boolean")
_PIECE = "file string, chunk long, line long, open_left boolean, open_right boolean, text binary"


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unescaped quotes before each bracket or comma, their places, +1 / -1 / 0), and all quotes as the last entry."""
    quotes = np.flatnonzero(data == 34)
    solid = np.flatnonzero(data != 92)
    # backslashes right before a quote: an odd number escapes it
    before = np.searchsorted(solid, quotes) - 1
    run = quotes - 1 - np.where(before >= 0, solid[np.maximum(before, 0)], -1) if len(solid) else quotes
    quotes = quotes[run % 2 == 0]
    up, down = (data == 123) | (data == 91), (data == 125) | (data == 93)
    places = np.flatnonzero(up | down | (data == 44))
    step = up[places].astype(np.int64) - down[places]
    return np.append(np.searchsorted(quotes, places), len(quotes)), places, step


def _summary(data: bytes) -> tuple[int, int, int, int, int]:
    """(quotes, change of depth and least depth reached, if the chunk starts outside of a string and if inside)."""
    seen, _, step = _marks(np.frombuffer(data, np.uint8))
    out = []
    for inside in (0, 1):
        depth = np.cumsum(step[(seen[:-1] + inside) % 2 == 0])
        out.append((int(depth[-1]), int(depth.min())) if len(depth) else (0, 0))
    return int(seen[-1]), out[0][0], out[1][0], out[0][1], out[1][1]


def _chunks(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """The files' bytes in rows of about ``chunk_bytes`` with what the running sums need, in order of (block, nr)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nr, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            # every fragment but the first of a file has lost the bracket before it
            data = b"".join(held)
            root = data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1] == b"[" if at[1] == 0 and nr == 0 else None
            return _batch(_CHUNK, [[x] for x in (*at, nr, data, *_summary(data), root)])
        for batch in batches:
            files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
            for key, value in zip(zip(files, blocks), values):
                if key != at:
                    if held:
                        yield out()
                    at, nr, held, size = key, 0, [], 0
                elif size >= chunk_bytes:
                    yield out()
                    nr, held, size = nr + 1, [], 0
                if held or nr or at[1]:
                    held.append(b"{")
                held.append(value)
                size += len(value) + 1
        if held:
            yield out()
    lines = spark.read.option("lineSep", "{").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").cast("binary").alias("value")).mapInArrow(run, _CHUNK)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the array's elements in each chunk; ``open_left`` and ``open_right``: more of it may be in other chunks."""
    for batch in batches:
        for file, chunk, raw, inside, depth in zip(*(batch.column(i).to_pylist() for i in range(5))):
            data = np.frombuffer(raw, np.uint8)
            seen, places, step = _marks(data)
            outside = (seen[:-1] + inside) % 2 == 0
            places, step = places[outside], step[outside]
            level = depth + np.cumsum(step)
            begin, stop, opened = 0, len(raw), depth > 0
            if not opened:
                first = np.flatnonzero(level == 1)
                if not len(first):
                    continue
                begin, level, step, places = int(places[first[0]]) + 1, level[first[0]:], step[first[0]:], places[first[0]:]
            end = np.flatnonzero(level == 0)
            if len(end):
                stop = int(places[end[0]])
            commas = places[(step == 0) & (level == 1) & (places >= begin) & (places < stop)].tolist()
            lefts, rights = [begin, *(c + 1 for c in commas)], [*commas, stop]
            n = len(lefts)
            yield _batch(_PIECE, [[file] * n, [chunk] * n, list(range(n)), [opened] + [False] * (n - 1),
                                  [False] * (n - 1) + [not len(end)], [raw[a:b] for a, b in zip(lefts, rights)]])


def array_elements(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(value, seq): one row per element of the JSON arrays in the files, as the text that stands there, trimmed.

    seq orders the elements: (file, start: chunk of the file, line: place in the chunk). A file that isn't an array
    is one element. The element ``null`` is a null value; an empty array and a blank file have no rows. Of a damaged file the
    elements before the damage are read, the damaged one is text that is no JSON; what follows the array's end is left out.
    A plain file is read by many tasks, a gzip file by one, in chunks. Memory per task: a chunk or an element, whichever is larger.
    """
    chunks = durable(_chunks(spark, path, chunk_bytes))
    order = Window.partitionBy("file").orderBy("block", "nr")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.drop("data").withColumn("chunk", F.row_number().over(order).cast("long")).withColumn(
        "is_array", F.first("is_array", ignorenulls=True).over(order)).withColumn(
        "inside", F.coalesce(F.sum("quotes").over(past), F.lit(0)) % 2)
    rise, low = (F.when(F.col("inside") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")) for x in ("rise", "low"))
    rows = rows.withColumn("depth", F.coalesce(F.sum(rise).over(past), F.lit(0)))
    # the array has ended once its depth was down at zero again
    ended = F.coalesce(F.min(F.col("depth") + F.col("_low")).over(past), F.lit(1)) <= 0
    rows = rows.withColumn("_low", low).withColumn("ended", ended).select(
        "file", "block", "nr", "chunk", "inside", "depth", "is_array", "ended")
    placed = chunks.select("file", "block", "nr", "data").join(rows, ["file", "block", "nr"])
    inner = placed.filter("is_array AND NOT ended").select("file", "chunk", "data", "inside", "depth").mapInArrow(_pieces, _PIECE)
    other = placed.filter("NOT is_array").select(
        "file", "chunk", F.lit(0).cast("long").alias("line"), (F.col("chunk") > 1).alias("open_left"),
        F.lit(True).alias("open_right"), F.col("data").alias("text"))
    pieces = durable(inner.unionByName(other).withColumn("text", F.col("text").cast("string")))
    border = pieces.filter("open_left OR open_right")
    # an element's parts carry the number of its first one; one or two small rows per chunk are ordered here
    by_place = Window.partitionBy("file").orderBy("chunk", "line")
    head = F.when(~F.col("open_left"), F.struct("chunk", "line"))
    ranked = border.select("file", "chunk", "line", F.last(head, ignorenulls=True).over(by_place).alias("head"))
    joined = border.join(ranked, ["file", "chunk", "line"]).groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "line", "text"))).alias("parts")).select(
        "file", F.col("head.chunk").alias("chunk"), F.col("head.line").alias("line"), F.array_join("parts.text", "").alias("text"))
    whole = pieces.filter("NOT open_left AND NOT open_right").select("file", "chunk", "line", "text")
    text = F.regexp_replace("text", r"^[\x20\t\r\n\x{FEFF}]+|[\x20\t\r\n]+$", "")
    found = whole.unionByName(joined).select("file", "chunk", "line", text.alias("text")).filter("text <> ''")
    return found.select(
        F.when(F.col("text") != "null", F.col("text")).alias("value"),
        F.struct(F.col("file"), F.col("chunk").alias("start"), F.col("line")).alias("seq"))
