"""Near-duplicate detection with SuperMinHash signatures, banding, verification and components.

SuperMinHash gives every element a random permutation of the signature's places, and place p[j]
the value j + u_j: the ranks of one element are correlated, which lowers the variance, and once
every place holds a value below j + 1 no later rank can win, so long texts need one or two ranks
per element instead of one hash per place.

Plan: texts -> (set size, set hash, band hashes), one pass. Equal sets become one class first, so
copies never meet in a bucket. Bands of class representatives form buckets. Instead of all pairs of
a bucket, the member met most often is compared with the others; links join components; then members of
one bucket that are still in different components are compared, unless their rare shingles rule a
link out, so no link between two components is lost. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import text as tx
from ratingloom.llm.components import components
from ratingloom.session import durable

BANDS, ROWS = 20, 4
#: A shingle is rare if at most so many of the sets that are still to be compared have it.
RARE = 64
_TOP = np.uint64(56)


def shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a small batch (column "text")."""
    data, offsets = tx.buffers(batch.column("text"))
    data = tx.lower(data)
    starts, ends, first = tx.words(data, offsets)
    rolling = tx.words_rolling(tx.bytes_rolling(data).of(starts, ends))
    grams = rolling.every(words)
    for row in range(batch.num_rows):
        a, b = first[row], first[row + 1]
        if b - a >= words:
            found = np.sort(grams[a:b - words + 1])
            yield row, found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            yield row, rolling.of(np.array([a]), np.array([b]))
        else:
            yield row, np.zeros(0, np.uint64)


def super_minhash(elements: np.ndarray, places: int) -> np.ndarray:
    """The signature of a set of 64-bit hashes; a place holds rank << 56 | 56 random bits."""
    n = len(elements)
    signature = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    order = None
    rows = np.arange(n)
    for j in range(places):
        draw = tx.mix(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = j + (draw % np.uint64(places - j)).astype(np.int64)
        value = tx.mix(draw) >> np.uint64(8) | np.uint64(j) << _TOP
        if order is None:
            place, first = k, k
        else:
            place = order[rows, k]
            order[rows, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(signature, place, value)
        if int(signature.max() >> _TOP) <= j:
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8), (n, 1))
            order[rows, first] = 0
            order[:, 0] = first
    return signature


def _bands(signature: np.ndarray, bands: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64)
    for column in signature.reshape(bands, -1).T:
        h = tx.mix(h * np.uint64(0xD6E8FEB86659FD93) + column)
    return h.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash and band hashes (null for an empty set) of every row."""
    if bands * rows > 250:
        raise ValueError("at most 250 places")
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                sizes, hashes, keys = [], [], []
                for _, found in shingle_sets(batch, words):
                    sizes.append(len(found))
                    hashes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    keys.append(_bands(super_minhash(found, bands * rows), bands) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def packed_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, elements: the shingle set as sorted 64-bit numbers in one binary."""
    schema = pa.schema([("node", pa.int64()), ("elements", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
                    [found.tobytes() for _, found in shingle_sets(batch, words)], pa.binary())], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, elements binary")


def confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) with share[1] * intersection >= share[0] * union of their full sets."""
    part, whole = share

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x = np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _several_components(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are in different components."""
    split = rows.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return rows.join(split.filter("lo <> hi").select("band", "key"), ["band", "key"])


def _elements(sets: DataFrame) -> DataFrame:
    """node, element of every set."""
    schema = pa.schema([("node", pa.int64()), ("element", pa.int64())])

    def run(batches):
        for batch in batches:
            for node, packed in zip(batch.column("node"), batch.column("elements")):
                found = np.frombuffer(packed.as_buffer(), np.int64)
                for at in range(0, len(found), 50_000):
                    part = pa.array(found[at:at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.repeat(node, len(part)), part], schema=schema)
    return sets.mapInArrow(run, "node long, element long")


def _left_over_pairs(rows: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may be linked; ``rows``: band, key, node, component.

    Shingles that at most RARE of these sets have are rare. Two sets that share c rare ones share at
    most c + min(common) in all, ``common`` being the size without rare ones. So pairs that share a rare
    shingle are met through it, at most RARE^2 / 2 for one shingle; pairs that share none are bounded by
    their common shingles and sizes. In a group of copies with edits of their own, the strongly edited
    ones are thereby settled without being compared.
    """
    part, whole = share
    state = rows.select("node", "component").distinct()
    elements = durable(_elements(sets.join(state.select("node"), "node", "left_semi")))
    held = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE)
    rare = elements.join(held, "element")
    sizes = sets.select("node", F.floor(F.length("elements") / 8).alias("size")).groupBy("node").agg(
        F.min("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    per = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    # an id with several texts is not pruned
    common = F.when(F.col("texts") == 1, F.col("size") - F.coalesce("rare", F.lit(0))).otherwise(2 ** 40)
    state = durable(state.join(sizes, "node").join(per, "node", "left").select(
        "node", "component", "size", common.alias("common")))
    most = F.floor(F.col("common") * (part + whole) / part) - F.col("size")
    # through rare shingles
    known = rare.filter("n > 1").select("element", "node").join(state, "node")
    x, y = known.alias("x"), known.alias("y")
    through = x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.node") < F.col("y.node"))
                     & (F.col("x.component") != F.col("y.component"))).groupBy(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("x.size") + F.col("y.size")).alias("both"),
        F.least("x.common", "y.common").alias("common")).agg(F.count(F.lit(1)).alias("c")).filter(
        (F.col("c") + F.col("common")) * (part + whole) >= F.col("both") * part).select("a", "b")
    # through buckets
    limited = rows.select("band", "key", "node").join(state.withColumn("most", most), "node")
    least = limited.groupBy("band", "key").agg(F.min("size").alias("least"))
    fit = durable(_several_components(limited.join(least, ["band", "key"]).filter("most >= least").drop("least")))
    x, y = fit.alias("x"), fit.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
                 & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
                 & (F.col("x.size") <= F.col("y.most")) & (F.col("y.size") <= F.col("x.most"))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return through.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100),
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are separated by space and tab..return, A-Z count as a-z. Null or empty text: an empty
    set, linked with nothing. Rows without doc_id are linked with nothing: component_id null, kept.
    Rows with one doc_id are one node: a link of any of them is a link of the id, and all are kept
    or dropped together. Ties do not matter: a component is named after its smallest id. Extra
    columns are ignored; an empty table gives an empty result.

    A pair at the exact threshold shares no band with probability (1 - t**rows) ** bands
    (4e-7 at 0.85, 3e-5 at 0.8); above it the chance falls quickly.
    """
    signed = durable(signatures(docs, words, bands, rows))
    named = signed.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    # written tables, not aggregates, on both sides of a join: Spark can then split the rows of a hot key
    classes = durable(named.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    buckets = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = durable(buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = durable(buckets.join(shared, ["band", "key"]).select("band", "key", "size", "node"))
    # how often a node meets others: the best middle of a star
    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    ranked = members.join(reach, "node")
    middle = durable(ranked.groupBy("band", "key").agg(
        F.max(F.struct("reach", (-F.col("node")).alias("minus"))).alias("m")).select(
        "band", "key", (-F.col("m.minus")).alias("middle")))
    around = members.join(middle, ["band", "key"]).filter("node <> middle")
    involved = reach.select(F.col("node").alias("doc_id"))
    sets = durable(packed_sets(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), words).distinct())
    stars = around.select(
        F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).distinct()
    # an id with several texts is one node: it is linked with the classes of all of them
    several = named.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("lo <> hi")
    own = named.join(several.select("doc_id"), "doc_id").join(classes.select("set_hash", "node"), "set_hash").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = durable(confirmed(stars, sets, share).unionByName(own))
    label = durable(components(links))
    # what is left: members of a bucket in different components; pairs with the middle are done
    tagged = around.join(label, "node", "left").select(
        "band", "key", "node", F.coalesce("component", "node").alias("component"))
    open_rows = durable(_several_components(tagged))
    rest = _left_over_pairs(open_rows, sets, share)
    more = durable(confirmed(rest, sets, share))
    if not more.isEmpty():
        label = durable(components(links.unionByName(more)))
    named_classes = durable(classes.select("set_hash", "node").join(label, "node", "left").select(
        "set_hash", F.coalesce("component", "node").alias("component")))
    out = signed.drop("bands").join(named_classes, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, share=(85, 100))


QUERIES = {"op4_near_dedup": op4_near_dedup}

ORACLES = {"op4_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (g)
        WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w JOIN comp ON comp.node = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id"""}
