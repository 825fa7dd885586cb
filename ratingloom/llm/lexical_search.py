"""Ranked lexical search: all documents are streamed through an Aho-Corasick automaton of the items' terms.

No index of the documents is built. Every byte that isn't part of a term becomes a space, terms stand in the
automaton between two spaces, so that it counts whole terms directly in the text; what it finds is mapped to the
items that hold the term. One scan writes every document's length and term counts; document frequencies and the
corpus length follow from that table, and a second pass over it scores. Tasks keep the best documents per item.

Items are dealt into shards of bounded size, each with an automaton of its own; all terms of an item are in one
shard and the corpus figures are those of all documents, so scores don't depend on the shards.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.functions.skew import top_per_group
from ratingloom.llm import text as tx
from ratingloom.session import durable

BEST = 20
#: Bytes of item texts that an automaton is made of at most, unless a single item has more.
SHARD_BYTES = 8 << 20
#: Scores that are held at a time: documents of a step x items.
CELLS = 1 << 21

# ASCII letters (in lower case) and digits, and every byte of other characters; the rest are spaces
_GUARD = np.full(256, 32, np.uint8)
_GUARD[48:58], _GUARD[97:123], _GUARD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_GUARD[65:91] = np.arange(97, 123)


def guarded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with a space for every byte outside of terms, and one before, between and behind them."""
    return np.insert(_GUARD[data], offsets, np.uint8(32))


def term_counts(guarded_texts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of terms of every text."""
    inside = guarded_texts != 32
    begun = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside[1:] & ~inside[:-1], out=begun[2:])
    at = offsets + np.arange(len(offsets))
    return begun[at[1:] + 1] - begun[at[:-1] + 1]


def terms_of(text: str) -> list[str]:
    """The terms of a text, one character per byte."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return _GUARD[data].tobytes().decode("latin-1").split(" ") if len(data) else []


class ItemTerms:
    """Terms of a shard of items, by number, and the items of each: (term, item, how often) by term."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.terms: list[str] = []
        number: dict[str, int] = {}
        rows = []
        for nr, (_, text) in enumerate(items):
            for term, n in Counter(t for t in terms_of(text) if t).items():
                rows.append((number.setdefault(term, len(number)), nr, n))
        self.terms = list(number)
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(len(number) + 1))
        self.item, self.times = table[:, 1], table[:, 2]

    @functools.cached_property
    def machine(self):
        """The automaton; it is built once per worker, where it is used, and never sent."""
        import ahocorasick
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for nr, term in enumerate(self.terms):
            machine.add_word(f" {term} ", nr)
        machine.make_automaton()
        return machine

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of every text; text, term, how often: of every item term found, by text)."""
        whole = guarded(data, offsets)
        found = np.fromiter(chain.from_iterable(self.machine.iter(whole.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        owner = np.searchsorted(offsets + np.arange(len(offsets)), found[:, 0] - 1, "right") - 1
        key, times = np.unique(owner * len(self.terms) + found[:, 1], return_counts=True)
        return term_counts(whole, offsets), key // len(self.terms), key % len(self.terms), times

    def score(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, rows: int, weights: np.ndarray,
              length: np.ndarray) -> np.ndarray:
        """Scores, documents x items, from the terms of the documents; ``length`` is each one's length norm."""
        gain = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * length[row])).astype(np.int64)
        fan = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
        out = np.zeros(rows * len(self.ids), np.int64)
        np.add.at(out, np.repeat(row, fan) * len(self.ids) + self.item[at], np.repeat(gain, fan) * self.times[at])
        return out.reshape(rows, len(self.ids))


def length_norms(counts: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """75 + (25 n N) div L of every document; Python's integers where the product is beyond 64 bits."""
    if len(counts) and 25 * int(counts.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(n) * documents // terms for n in counts], np.int64)
    return 75 + 25 * counts * documents // max(terms, 1)


class _Best:
    """The best documents per item so far: a bounded table of candidates and what a new one must reach."""

    def __init__(self, items: int, best: int):
        self.best, self.least = best, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        new = (item, scores[row, item], missing[row].astype(np.int64), ids[row])
        item, score, none, doc = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((doc, none, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        keep = order[rank < self.best]
        self.rows = [x[keep] for x in (item, score, none, doc)]
        last = order[rank == self.best - 1]
        self.least[item[last]] = score[last]


def _shards(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(items with a shard number, number of shards): shards have ``limit`` bytes at most, or a single item."""
    size = F.octet_length("text") + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // limit))
    while True:
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        over = dealt.groupBy("shard").agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c")).filter(
            (F.col("s") > limit) & (F.col("c") > 1))
        if n > 1 << 40 or not over.limit(1).count():
            return dealt, n
        n = 2 * n + 1


_FOUND = "doc_id long, n long, term array<int>, times array<int>"


def _scan(docs: DataFrame, shared) -> DataFrame:
    """Per document its number of terms, and the item terms in it with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                data, offsets = tx.buffers(batch.column("text"))
                counts, row, term, times = shared.value.find(data, offsets)
                cuts = pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts),
                     pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))], names=["doc_id", "n", "term", "times"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def _frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """Documents per term; each task hands over one row per term it has met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(terms, np.int64)
        for batch in batches:
            count += np.bincount(np.asarray(batch.column("term").flatten(), np.int64), minlength=terms)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met])], names=["term", "df"])
    out = np.zeros(terms, np.int64)
    for r in found.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # a row per term of the shard, which is bounded
    return out


def _best(found: DataFrame, shared, weights: np.ndarray, documents: int, terms: int, best: int) -> DataFrame:
    """The ``best`` documents per item of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        kept = _Best(len(items.ids), best)
        step = max(1, CELLS // max(len(items.ids), 1))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                sizes = np.asarray(batch.column("term").value_lengths(), np.int64)
                term = np.asarray(batch.column("term").flatten(), np.int64)
                times = np.asarray(batch.column("times").flatten(), np.int64)
                norms = length_norms(np.asarray(batch.column("n"), np.int64), documents, terms)
                scores = items.score(np.repeat(np.arange(len(sizes)), sizes), term, times, len(sizes), weights, norms)
                ids = batch.column("doc_id")
                kept.add(scores, np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()))
        item, score, none, doc = kept.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array([items.ids[i] for i in item], pa.int64()),
             pa.array(doc, mask=none.astype(bool)), pa.array(score)], names=["item", "item_id", "doc_id", "score"])
    return found.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every item with a score above 0.

    Equal scores: by doc_id, null last; rows of ``docs`` that repeat are documents of their own. Null texts have no
    terms. Rows of ``items`` that repeat are one item; an id with two texts, or null as an id, has a list for each
    text. Extra columns are ignored; without documents or items there are no rows.
    """
    spark, out = docs.sparkSession, None
    items = items.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").distinct()
    dealt, shards = _shards(items, shard_bytes)
    for nr in range(shards):
        rows = dealt.filter(F.col("shard") == nr).orderBy("item_id", "text").select("item_id", "text").collect()  # bounded
        table = ItemTerms([tuple(r) for r in rows])
        if not table.terms:
            continue
        shared = spark.sparkContext.broadcast(table)  # a few times shard_bytes
        found = durable(_scan(docs, shared))
        documents, terms = found.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = _frequencies(found, len(table.terms))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in frequency], np.int64)
        rows = _best(found, shared, weights, documents, terms, best)
        # two steps, as every task of the scan may have all ``best`` rows of an item
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
        rows = top_per_group(rows.withColumn("part", part), ["item", "part"], order, best).drop("rank", "part")
        rows = durable(top_per_group(rows, "item", order, best).drop("item"))
        shared.unpersist()
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long, rank long")
    return out.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_lexical_search": op13_lexical_search}

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {"op13_lexical_search": f"""
WITH doc AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
len AS (SELECT doc_id, len(t) AS n FROM doc WHERE len(t) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS c, CAST(sum(n) AS BIGINT) AS l FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doc) GROUP BY 1, 2),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term),
item AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (
  SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (doc_id), corpus GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""}
