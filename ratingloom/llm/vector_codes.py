"""Vector code compression: product codes with integer codebooks, searched in the Walsh-Hadamard domain.

Vectors become integers floor(scale * x) and are cut into equal parts; a part's code is its nearest codebook
entry. Parts and entries are padded with zeros to a power of two and transformed by an integer Walsh-Hadamard
matrix, which multiplies every squared distance by its size. The squared differences of the transformed
components are accumulated in sequency order, slow changes first, and an entry is left out as soon as its sum
so far exceeds the whole distance of another one. All of it is integer arithmetic, so the result is exact.

A training round is one scan: tasks hand over one sum per entry and position. Only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.session import durable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at a time.
CHUNK = 2048
#: Components up to this size are added up in 64 bits, as a task has far fewer than 2**36 rows; others as Python's integers.
SMALL = 1 << 26
_MOST = (1 << 63) - 1


def sequency_hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of ``size`` (a power of two), rows by their number of sign changes."""
    m = np.ones((1, 1), np.int64)
    while len(m) < size:
        m = np.block([[m, m], [m, -m]])
    return m[np.argsort((np.diff(m, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two and transformed, in sequency order."""
    width = parts.shape[1]
    size = 1 << max(width - 1, 0).bit_length()
    return parts @ sequency_hadamard(size)[:, :width].T.astype(parts.dtype)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of ``entries``, its squared distance) of every row, both transformed.

    Ties go to the lower number. The entry that is nearest in the first component gives the bound; pairs
    stay while their sum is not above it.
    """
    n, size = rows.shape
    if not n or not size:
        return np.zeros(n, np.int64), np.zeros(n, rows.dtype)
    gap = rows[:, :1] - entries[:, 0][None, :]
    sums = gap * gap
    guess = np.argmin(sums, axis=1)
    gap = rows - entries[guess]
    bound = (gap * gap).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for j in range(1, size):
        gap = rows[row, j] - entries[entry, j]
        sums = sums + gap * gap
        stay = sums <= bound[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
    # what is left are whole distances, by row and entry; the guess is always among them
    starts = np.searchsorted(row, np.arange(n))
    if sums.dtype == object:
        best = np.array([min(x) for x in np.split(sums, starts[1:])], object)
    else:
        best = np.minimum.reduceat(sums, starts)
    at = np.flatnonzero(sums == best[row])
    first = at[np.searchsorted(row[at], np.arange(n))]
    return entry[first], best // size


@dataclass
class Codebooks:
    """``entries[p]`` has the integer entries of part ``p``, one per row."""

    entries: list[np.ndarray]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, one column per part; squared distances summed over the parts) of integer vectors."""
        parts = len(self.entries)
        width = vectors.shape[1] // parts
        size = 1 << max(width - 1, 0).bit_length()
        most = _largest(vectors) + max(map(_largest, self.entries))
        exact = np.int64 if parts * size ** 3 * most ** 2 < 1 << 62 else object  # of the scaled distances
        codes = np.zeros((len(vectors), parts), np.int64)
        errors = np.zeros(len(vectors), exact)
        for p, entries in enumerate(self.entries):
            known = transformed(entries.astype(exact))
            for a in range(0, len(vectors), CHUNK):
                rows = transformed(vectors[a:a + CHUNK, p * width:(p + 1) * width].astype(exact))
                codes[a:a + CHUNK, p], error = nearest(rows, known)
                errors[a:a + CHUNK] += error
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, one row each, filled up with zeros to ``width``.

    If one is beyond 62 bits, all are kept as Python's integers.
    """
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if len(scaled) and not (np.abs(scaled) < 2.0 ** 62).all():
        values = np.array([int(x) * scale if abs(x) >= 2.0 ** 53 else int(np.floor(x * scale)) for x in flat.tolist()], object)
    else:
        values = scaled.astype(np.int64)
    out = np.zeros((len(sizes), width), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def usable(vec: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    one = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(vec.isNotNull() & F.forall(vec, one), F.lit(False))


def _limbs(sums: np.ndarray) -> list[np.ndarray]:
    """Sums as 32-bit digits, the last one signed; digits of one place can be added up without an overflow."""
    most = max((abs(int(x)) for x in sums), default=0)
    n = max(2, most.bit_length() // 32 + 1)
    return [((sums >> 32 * i) & 0xFFFFFFFF if i < n - 1 else sums >> 32 * i).astype(np.int64) for i in range(n)]


def _moved(vectors: DataFrame, books: Codebooks, width: int, scale: int) -> Codebooks:
    """Every entry replaced by the componentwise floor of the mean of its parts; unused ones stay."""
    parts, size = len(books.entries), width // len(books.entries)
    most = len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(parts * most, np.int64)
        total: np.ndarray = np.zeros((parts * most, size), np.int64)
        for batch in batches:
            rows = integers(batch.column("vec"), width, scale)
            codes, _ = books.assign(rows)
            if rows.dtype == object or _largest(rows) > SMALL:
                total, rows = total.astype(object), rows.astype(object)
            for p in range(parts):
                slot = p * most + codes[:, p]
                count += np.bincount(slot, minlength=parts * most)
                np.add.at(total, slot, rows[:, p * size:(p + 1) * size])
        used = np.flatnonzero(count)
        limbs = _limbs(total[used].ravel())
        places = len(used) * size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.repeat(used, size), len(limbs))), pa.array(np.tile(np.arange(size), len(used) * len(limbs))),
             pa.array(np.repeat(np.arange(len(limbs)), places)), pa.array(np.tile(np.repeat(count[used], size), len(limbs))),
             pa.array(np.concatenate(limbs))], names=["slot", "pos", "limb", "n", "digit"])

    # entries x width rows, a few digits each, however many vectors there are
    rows = vectors.select("vec").mapInArrow(run, "slot long, pos long, limb long, n long, digit long").groupBy(
        "slot", "pos", "limb").agg(F.sum("n").alias("n"), F.sum("digit").alias("digit")).collect()
    sums: dict[tuple[int, int], int] = {}
    counts: dict[tuple[int, int], int] = {}
    for r in rows:
        at = r["slot"], r["pos"]
        sums[at] = sums.get(at, 0) + (int(r["digit"]) << 32 * r["limb"])
        counts[at] = max(counts.get(at, 0), r["n"])  # every task has the lowest digit
    moved = [e.astype(object) for e in books.entries]
    for (slot, pos), total in sums.items():
        moved[slot // most][slot % most, pos] = total // counts[slot, pos]
    return Codebooks([_compact(e) for e in moved])


def _compact(x: np.ndarray) -> np.ndarray:
    return x if any(abs(int(v)) >= 1 << 62 for v in x.ravel()) else x.astype(np.int64)


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          scale: int = SCALE) -> Codebooks:
    """Codebooks from ``vectors`` (id, vec: usable ones).

    They start as the parts of the vectors with the smallest ids (ids that are null come last, equal ids by
    vector). With fewer vectors than ``entries`` there are fewer entries; without any, none.
    """
    first = vectors.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").toArrow()
    rows = integers(first.column("vec").combine_chunks(), width, scale) if first.num_rows else np.zeros((0, width), np.int64)
    size = width // parts
    books = Codebooks([rows[:, p * size:(p + 1) * size] for p in range(parts)])
    for _ in range(rounds if len(rows) else 0):
        books = _moved(vectors, books, width, scale)
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """((id, label, codes: one byte per part, error), codebooks) of all usable rows; further columns are ignored.

    Rows whose vector is null or has a null or non-finite component are left out; ids and labels may be null, equal
    rows stay. Vectors are filled up with zeros to the longest one's length and that to a multiple of ``parts``; an
    empty vector is all zeros. An error beyond 64 bits is given as the largest long. An empty table gives no rows and
    empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: up to 256 entries")
    rows = vectors.select(F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
                          F.col(vec).alias("vec")).filter(usable(F.col("vec")))
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = -(-max(longest, 1) // parts) * parts
    books = train(rows.select("id", "vec"), width, parts, entries, rounds, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assign(integers(batch.column("vec"), width, scale))
            raw = codes.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.array([raw[i:i + parts] for i in range(0, len(raw), parts)], pa.binary()),
                 pa.array([min(int(e), _MOST) for e in errors], pa.int64())], names=["id", "label", "codes", "error"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType),
                           T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors summed over equal labels; rows without label belong together.

    Sums are made map-side; the joined side is a written table of a row per label, so that Spark can send it to all
    tasks if it is small and split the rows of a common label if it isn't.
    """
    total = durable(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")).select(
        F.col("label").alias("_label"), F.least(F.col("_sum"), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error")))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return label_errors(durable(coded)).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}

_ASSIGN = """
d{r} AS (SELECT v.vec_id, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM part v JOIN book{r} c USING (p)),
a{r} AS (SELECT vec_id, p, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""

_MOVE = """
s{r} AS (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN part USING (vec_id, p), unnest(range(1, 5)) AS q(j) GROUP BY ALL),
m{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{r} GROUP BY ALL),
book{n} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN m{r} m USING (p, e))"""

ORACLES = {"op11_vector_codes": f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, v[4 * p + 1:4 * p + 4] AS x FROM whole, unnest(range(0, 16)) AS q(p)),
book0 AS (SELECT p, e, x FROM part JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole QUALIFY e < 64) USING (vec_id)),
{_ASSIGN.format(r=0)},{_MOVE.format(r=0, n=1)},{_ASSIGN.format(r=1)},{_MOVE.format(r=1, n=2)},{_ASSIGN.format(r=2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN whole USING (vec_id)"""}
