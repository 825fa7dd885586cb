"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over the
embedded bytes of a chunk; every filter's largest response per chunk is kept, and a text's largest
and mean chunk responses are combined into one probability. Training follows the largest responses
back, so its cost does not depend on the text length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.llm import text as tx

#: Bounds of the training sample: labelled texts, and chunks taken from one of them (spread evenly).
TRAIN_DOCS, TRAIN_CHUNKS = 4000, 12
CHUNK = 512
THRESHOLD = 0.7


@dataclass
class ByteNetwork:
    width: int = 10
    dims: int = 6
    filters: int = 24
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
            self.weights = {
                "embed": draw(256, self.dims, scale=0.5),
                "conv": draw(self.width * self.dims, self.filters, scale=0.2),
                "bias": np.zeros(self.filters, np.float32),
                "dense": draw(2 * self.filters, scale=0.1),
                "out": np.zeros(1, np.float32),
            }

    @property
    def step(self) -> int:
        """Chunks overlap by width - 1 bytes, so that every window lies in one."""
        return CHUNK - self.width + 1

    def chunk_starts(self, size: int) -> np.ndarray:
        return np.arange(0, max(size - self.width + 1, 1), self.step)

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk bytes, text of each chunk); the last chunk of a text is padded with zeros."""
        sizes = np.diff(offsets)
        counts = np.maximum(-(-np.maximum(sizes - self.width + 1, 1) // self.step), 1)
        owner = np.repeat(np.arange(len(sizes)), counts)
        nr = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = offsets[owner] + nr * self.step
        place = start[:, None] + np.arange(CHUNK)
        inside = place < offsets[owner + 1][:, None]
        padded = np.append(data, np.uint8(0))
        return np.where(inside, padded[np.minimum(place, len(data))], np.uint8(0)), owner

    def responses(self, chunks: np.ndarray, places: bool = False):
        """Largest response of every filter per chunk (and where it is)."""
        w = self.weights
        top = np.empty((len(chunks), self.filters), np.float32)
        where = np.empty((len(chunks), self.filters), np.int64) if places else None
        for at in range(0, len(chunks), 48):
            x = w["embed"][chunks[at:at + 48]].reshape(-1, CHUNK * self.dims)
            view = np.lib.stride_tricks.sliding_window_view(x, self.width * self.dims, axis=1)[:, ::self.dims]
            y = (view.reshape(-1, self.width * self.dims) @ w["conv"]).reshape(len(x), -1, self.filters)
            top[at:at + 48] = y.max(axis=1)
            if places:
                where[at:at + 48] = y.argmax(axis=1)
        top += w["bias"]
        return (top, where) if places else top

    def _pooled(self, top: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        act = np.maximum(top, 0)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        counts = np.diff(np.append(first, len(owner)))
        return (np.hstack([np.maximum.reduceat(act, first), np.add.reduceat(act, first) / counts[:, None]]),
                act, counts)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every text."""
        if len(offsets) < 2:
            return np.zeros(0)
        parts = []
        for at in range(0, len(offsets) - 1, 256):
            cut = offsets[at:at + 257]
            parts.append(self._score_some(data[cut[0]:cut[-1]], cut - cut[0]))
        return np.concatenate(parts)

    def _score_some(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        chunks, owner = self.chunks(data, offsets)
        pooled, _, _ = self._pooled(self.responses(chunks), owner)
        z = pooled @ self.weights["dense"] + self.weights["out"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 32,
            rate: float = 0.004, least_steps: int = 400) -> ByteNetwork:
        """Adam over mini-batches of texts; ``owner`` (ascending) tells the text of every chunk.

        Small samples are gone through more often, up to ``least_steps`` batches.
        """
        rng = np.random.default_rng(self.seed)
        first = np.searchsorted(owner, np.arange(len(labels) + 1))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        epochs = max(epochs, -(-least_steps // -(-len(labels) // batch)))
        steps, total = 0, epochs * -(-len(labels) // batch)
        prior = np.clip(labels.mean(), 0.02, 0.98)
        self.weights["out"][:] = np.log(prior / (1 - prior))
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                texts = order[at:at + batch]
                rows = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts])
                local = np.repeat(np.arange(len(texts)), first[texts + 1] - first[texts])
                grads = self._gradients(chunks[rows], local, labels[texts])
                steps += 1
                lr = rate * (1 - steps / (total + 1))
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] -= lr * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-7)
        return self

    def _gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.filters
        top, where = self.responses(chunks, places=True)
        pooled, act, counts = self._pooled(top, owner)
        z = pooled @ w["dense"] + w["out"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)).astype(np.float32)
        dpool = dz[:, None] * w["dense"]
        largest = act == pooled[owner][:, :f]
        dact = dpool[owner][:, f:] / counts[owner][:, None] + dpool[owner][:, :f] * largest
        dact = np.where(top > 0, dact, 0).astype(np.float32)
        row, flt = np.nonzero(dact)
        g = dact[row, flt]
        taps = chunks[row[:, None], where[row, flt][:, None] + np.arange(self.width)]  # bytes under the filters
        x = w["embed"][taps].reshape(len(row), -1)
        dconv = np.zeros_like(w["conv"].T)
        np.add.at(dconv, flt, g[:, None] * x)
        dx = (g[:, None] * w["conv"].T[flt]).reshape(-1, self.dims)
        dembed = np.zeros_like(w["embed"])
        np.add.at(dembed, taps.ravel(), dx)
        return {"embed": dembed, "conv": dconv.T.copy(), "bias": dact.sum(0), "dense": pooled.T @ dz + 1e-4 * w["dense"],
                "out": dz.sum(keepdims=True)}


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def single_labels(labels: DataFrame, label: str, fold: tuple[int, int]) -> DataFrame:
    """doc_id, y of the labelled ids outside of the held-out fold.

    Ids with contradicting labels are left out, rows that repeat count once.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(
        ~held_out(F.col("doc_id"), *fold))
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(label).alias("y"), F.max(label).alias("hi")).filter("y = hi").select("doc_id", F.col("y").cast("int"))


def chosen(known: DataFrame, label: str, size: int) -> DataFrame:
    """At most ``size`` rows of single_labels, chosen by hash."""
    return known.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(size)


def training_sample(labels: DataFrame, label: str, fold: tuple[int, int], size: int) -> DataFrame:
    """doc_id, y of at most ``size`` labelled ids (see single_labels), chosen by hash."""
    return chosen(single_labels(labels, label, fold), label, size)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, y, text: one row per id of ``sample``, however many rows of ``docs`` have it."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select(
        "doc_id", "y", "one.text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (4, 2),
          size: int = TRAIN_DOCS) -> ByteNetwork:
    """Fit a network on a bounded sample: ``size`` texts, TRAIN_CHUNKS chunks spread over each.

    Without any labelled text of both kinds the network answers 0.99 for everything, so that
    nothing is rejected for want of labels.
    """
    net = ByteNetwork()
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("chunks", pa.binary())])

    def cut(batches):
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                data, offsets = tx.buffers(batch.column("text"))
                taken = []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    parts, _ = net.chunks(data[a:b], np.array([0, b - a]))
                    spread = np.unique(np.linspace(0, len(parts) - 1, TRAIN_CHUNKS).astype(int))
                    taken.append(parts[spread].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("y"), pa.array(taken, pa.binary())], schema=schema)
    sample = training_sample(labels, label, fold, size)  # at most ``size`` rows
    rows = sampled_texts(docs, sample).mapInArrow(
        cut, "doc_id long, y int, chunks binary").toPandas().sort_values(["doc_id", "chunks"])
    y = rows["y"].to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        net.weights["dense"][:] = 0
        net.weights["out"][:] = 4.6
        return net
    parts = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for c in rows["chunks"]]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return net.fit(np.concatenate(parts), owner, y)


def score_texts(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """``docs`` with one more column, ``score``, at the end: every row, null text as empty text, the rest as it is.

    If ``docs`` has a column of that name, underscores are put before the new one's.
    """
    name = "score"
    while name in docs.columns:
        name = f"_{name}"

    def run(batches):
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                scores = net.score(*tx.buffers(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                                 names=[*batch.schema.names, name])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(score_texts(docs, train(docs, labels)), (4, 2))


def scored(rows: DataFrame, fold: tuple[int, int]) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
