"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become token pieces of at most one sequence; pieces are dealt evenly into blocks of bounded
size, and every block is packed on its own by several islands. A solution is a set of bins. Crossover
injects whole well-filled bins of one parent into another, removes the bins that then hold a piece
twice, and best-fits what was displaced. Between epochs each island's best solutions move to the next
island: the populations are a table, and migration is its shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import text as tx
from ratingloom.session import durable

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
BLOCK_PIECES, ISLANDS, EPOCHS, POPULATION, GENERATIONS, MIGRANTS = 8192, 2, 2, 4, 10, 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs``.

    A document's tokens are its ids and one ``end``. Longer ones are cut into pieces of ``capacity``,
    the first may be shorter. Null or empty text: one piece of one token. Rows without doc_id and
    rows that repeat are packed like all others; extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ratingloom.llm.tokens import encoder
        coder = encoder(tokenizer_path(vocabulary))
        last = np.array([end], "<u4").tobytes()
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                ids, offsets = coder.encode(batch.column("text"))
                raw = ids.astype("<u4").tobytes()
                out = []
                for row, (doc, a, b) in enumerate(zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(),
                                                      offsets[1:].tolist())):
                    size = b - a + 1
                    count = -(-size // capacity)
                    at = 0
                    for piece in range(count):
                        to = size - capacity * (count - 1 - piece)
                        part = raw[4 * (a + at):4 * min(a + to, b)] + (last if to == size else b"")
                        out.append((doc, piece, at, to - at, zlib.crc32(part)))
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- one island

class Bins:
    """Open bins by free space; ``put`` finds the fullest one that a piece fits into."""

    def __init__(self, capacity: int, free: dict[int, int] | None = None):
        self.capacity, self.mask, self.by_free = capacity, 0, {}
        self.next = max(free, default=-1) + 1 if free else 0
        for bin_, room in (free or {}).items():
            if room > 0:
                self._add(bin_, room)

    def _add(self, bin_: int, room: int) -> None:
        self.by_free.setdefault(room, []).append(bin_)
        self.mask |= 1 << room

    def put(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = self.by_free[room]
            bin_ = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
        else:
            room, bin_ = self.capacity, self.next
            self.next += 1
        if room > size:
            self._add(bin_, room - size)
        return bin_


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every piece when they are placed in ``order``."""
    bins, out = Bins(capacity), np.zeros(len(sizes), np.int32)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        out[i] = bins.put(size)
    return out


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: it prefers few bins, and full ones among as many."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0] / capacity
    return float((fill ** 2).sum() / max(len(fill), 1))


def crossover(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int,
              rng: np.random.Generator) -> np.ndarray:
    """``taker`` with some well-filled bins of ``giver``; displaced pieces are best-fitted, large ones first."""
    fill = np.bincount(giver, sizes)
    well = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.7))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 8), replace=False)] = True
    given = chosen[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[given]] = True
    # besides the bins with duplicates, some of the emptiest are dealt anew
    rest = np.bincount(taker, sizes, minlength=len(hit))
    poor = np.flatnonzero((rest > 0) & (rest < capacity * 0.97) & ~hit)
    if len(poor):
        hit[rng.choice(poor, -(-len(poor) // 3), replace=False)] = True
    moved = hit[taker] & ~given
    kept = ~hit[taker] & ~given
    names, inverse = np.unique(np.where(given, giver.astype(np.int64) + (1 << 32), taker.astype(np.int64))[given | kept],
                               return_inverse=True)
    out = np.full(len(sizes), -1, np.int32)
    out[given | kept] = inverse
    used = np.bincount(inverse, sizes[given | kept], minlength=len(names)).astype(int)
    bins = Bins(capacity, {b: capacity - u for b, u in enumerate(used.tolist())})
    bins.next = len(names)
    loose = np.flatnonzero(moved)
    noise = rng.integers(0, 48, len(loose))
    for i in loose[np.argsort(-(sizes[loose] + noise), kind="stable")].tolist():
        out[i] = bins.put(int(sizes[i]))
    return out


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator,
           size: int = POPULATION, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The fittest solutions after some generations, best first; stops when no bin can be saved."""
    bound = -(-int(sizes.sum()) // capacity)
    while len(population) < size:
        noise = rng.integers(0, 1 + 64 * len(population), len(sizes))
        population.append(best_fit(sizes, np.argsort(-(sizes + noise), kind="stable"), capacity))
    ranked = sorted(((fitness(sizes, p, capacity), -i, p) for i, p in enumerate(population)), reverse=True)[:size]
    for _ in range(generations):
        if len(np.unique(ranked[0][2])) <= bound:
            break
        giver, taker = rng.choice(len(ranked), 2, replace=False)
        child = crossover(sizes, ranked[giver][2], ranked[taker][2], capacity, rng)
        ranked = sorted([*ranked, (fitness(sizes, child, capacity), -len(population), child)],
                        key=lambda r: r[:2], reverse=True)[:size]
        population.append(child)
    return [p for _, _, p in ranked]


# ---------------------------------------------------------------- islands on Spark

_STATE = "block long, island int, rank int, fitness double, bins binary"


def _epoch(sizes: DataFrame, state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island of every block: old populations in, new ones out."""
    def run(key, pieces: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        size = pieces.sort_values("nr")["length"].to_numpy(np.int64)
        rng = np.random.default_rng([block, island, epoch])
        before = [np.frombuffer(b, np.int32) for b in old.sort_values(["fitness", "rank"], ascending=[False, True])["bins"]]
        after = evolve(size, before, capacity, rng)
        return pd.DataFrame({"block": block, "island": island, "rank": range(len(after)),
                             "fitness": [fitness(size, p, capacity) for p in after],
                             "bins": [p.astype(np.int32).tobytes() for p in after]})
    keys = ["block", "island"]
    return sizes.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(run, _STATE)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
         block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and offset there (see token_pieces for the pieces).

    Blocks hold about ``block_pieces`` pieces, dealt by a hash of the piece's number, so that equal
    documents don't gather in one. A block's last sequences may be part-filled, which costs about one
    sequence a block. An empty table gives an empty result.
    """
    pieces = durable(token_pieces(docs, capacity, vocabulary).withColumn("nr", F.monotonically_increasing_id()))
    total = pieces.count()
    blocks = max(1, -(-total // block_pieces))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("nr"), F.lit(blocks)))
    spark = docs.sparkSession
    loose = pieces.filter(F.col("length") < capacity).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null long
    sizes = loose.select("block", "nr", "length").withColumn(
        "island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = spark.createDataFrame([], _STATE)
    for epoch in range(epochs):
        if epoch:
            best = state.filter(F.col("rank") < MIGRANTS).withColumn("island", (F.col("island") + 1) % islands)
            state = state.unionByName(best)
        state = durable(_epoch(sizes, state, capacity, epoch))
    best = state.groupBy("block").agg(F.max_by("bins", F.struct(F.col("fitness"), -F.col("island"), -F.col("rank"))).alias("bins"))

    def place(key, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nr")
        rows["bin"] = np.frombuffer(chosen["bins"].iloc[0], np.int32)
        rows["sequence_id"] = (rows["bin"].astype("int64") * blocks + rows["block"]) * 2
        rows = rows.sort_values(["bin", "nr"])
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows.drop(columns=["bin", "block", "nr"])
    schema = ("doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    packed = loose.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, schema).withColumn(
        "doc_id", F.col("doc_id").cast("long"))
    full = pieces.filter(F.col("length") == capacity).drop("block").withColumn(
        "sequence_id", F.col("nr") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).drop("nr")
    return packed.unionByName(full)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
