"""Substring deduplication of words with sharded Aho-Corasick automata.

The edges of repeats (see repeats) come in shards. In each shard the windows that recur among its contexts
are confirmed as recurring passages and compiled into an automaton over word numbers; all contexts of
the shard are streamed through it, which locates every occurrence of every passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm import text as tx
from ratingloom.llm.repeats import repeated_spans, span_lists, with_spans

LENGTH, GRAM = 35, 12
#: Words that an automaton's passages have together at most, unless a single shard part has more.
AUTOMATON_WORDS = 400_000


def automaton(passages: list[tuple[int, ...]]):
    """An Aho-Corasick automaton that finds each passage of word numbers."""
    import ahocorasick
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for nr, passage in enumerate(passages):
        machine.add_word(passage, nr)
    machine.make_automaton()
    return machine


def engine(texts: list[bytes], length: int = LENGTH):
    """Spans and windows of contexts (see repeats): every occurrence of the passages that recur."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = tx.words(data, offsets)
    hashes = tx.bytes_rolling(data).of(starts, ends)
    number = pd.factorize(hashes)[0] + 1
    every = tx.words_rolling(hashes).every(length).view(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.flatnonzero(owner[:len(every)] == owner[length - 1:]) if len(every) else np.zeros(0, np.int64)
    key = every[at]
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order] = same[:-1] | same[1:]
    one = at[order[~same[:-1] & same[1:]]]  # one place of each recurring window
    words = number.tolist()
    found: list[tuple[int, int]] = []
    step = max(AUTOMATON_WORDS // length, 1)
    candidates = np.unique(owner[at[again]]).tolist()
    for lo in range(0, len(one), step):
        machine = automaton([tuple(words[p:p + length]) for p in one[lo:lo + step].tolist()])
        for c in candidates:
            a, b = int(first[c]), int(first[c + 1])
            found.extend((c, end - length + 1) for end, _ in machine.iter(tuple(words[a:b])))
    spans = np.array(found, np.int64).reshape(-1, 2)
    c, s = spans[:, 0], spans[:, 1]
    return ((c, s, np.full(len(c), length, np.int64)), (owner[at], at - first[owner[at]], key, again))


def remove_repeated_phrases(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (remaining words, joined by a space) of every row.

    Removed are all words in a window of ``length`` words that also starts at another place of any text.
    Null text has no words; a row that stands twice is two occurrences; rows without doc_id are treated
    like all others. Extra columns are ignored; an empty table gives none.
    """
    spans = repeated_spans(docs, length, gram, True, lambda texts: engine(texts, length))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                data, offsets = tx.buffers(batch.column("text"))
                starts, ends, first = tx.words(data, offsets)
                raw, out = data.tobytes(), []
                for (x, y), a, b in zip(span_lists(batch.column("spans")), first[:-1], first[1:]):
                    stay = np.ones(b - a, bool)
                    for s, e in zip(x.tolist(), y.tolist()):
                        stay[s:e] = False
                    kept = b" ".join(raw[s:e] for s, e in zip(starts[a:b][stay].tolist(), ends[a:b][stay].tolist()))
                    out.append((int(b - a), int(b - a - stay.sum()), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(
                    pa.array(c, t) for c, t in zip(zip(*out), schema.types[1:]))], schema=schema)
    return with_spans(docs, spans).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op10_phrase_dedup": op10_phrase_dedup}

ORACLES = {"op10_phrase_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM words, unnest(range(1, len(w) - 33)) AS r(i)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN again USING (h))),
flat AS (SELECT doc_id, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (
  SELECT f.doc_id, count(*) AS n_words, count(g.p) AS n_removed,
         string_agg(word, ' ' ORDER BY f.p) FILTER (g.p IS NULL) AS k
  FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.p = f.p GROUP BY f.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words w LEFT JOIN kept USING (doc_id)"""}
