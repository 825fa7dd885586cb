"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Index: per term the postings (item, impact) in item order, cut into blocks with their largest impact.
Impacts are divided by the item's own BM25 score, so that one threshold fits all items: 1 is an item
found in full. Query: every passage of every document, windows of twice the longest item's words at
half that distance, so that an item's words lie in one window. All items at or above the threshold are
retrieved and then verified: the shares of the 3-word shingles of the item's question (all but its last
sentence) and answer (its last sentence) that follow each other in the document near the passage.

The index is broadcast in shards of bounded size; documents meet one shard after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import text as tx

K1, B = 1.2, 0.75
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE, SHINGLE = 0.6, 0.6, 0.6, 3
BLOCK = 32
#: Part of the threshold that the frequent terms of an item may add unseen (performance only).
LEFT_OUT = 0.5
#: Bytes of item texts in one index shard.
SHARD_BYTES = 32 << 20
_KEPT = np.zeros(256, bool)
_KEPT[[9, 10, 11, 12, 13, 32]] = _KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_SLOTS = 20


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first term of each text): words in lower case without ASCII punctuation."""
    keep = _KEPT[data]
    data, offsets = tx.lower(data[keep]), np.concatenate(([0], np.cumsum(keep)))[offsets]
    starts, ends, first = tx.words(data, offsets)
    return tx.bytes_rolling(data).of(starts, ends), first


def _terms(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return term_hashes(data, np.array([0, len(data)]))[0]


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all but the last sentence, and of the last; one sentence is cut after two thirds."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if len(_terms(p))]
    if len(parts) > 1 and len(_terms(parts[-1])) >= SHINGLE:
        return _terms(" ".join(parts[:-1])), _terms(parts[-1])
    whole = _terms(text)
    cut = max(len(whole) * 2 // 3, 1)
    return whole[:cut], whole[cut:]


def shingles(terms: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of ``size`` terms in a row."""
    return np.unique(tx.words_rolling(terms).every(size))


def part_shingles(terms: np.ndarray) -> tuple[int, np.ndarray]:
    """(size, shingles) of a question or answer; one of fewer than SHINGLE terms is one shingle."""
    size = max(min(SHINGLE, len(terms)), 1)
    return size, shingles(terms, size)


@dataclass
class Index:
    ids: np.ndarray  # item ids in index order
    vocabulary: np.ndarray  # sorted term hashes
    start: np.ndarray  # postings of term t: start[t]:start[t + 1]
    items: np.ndarray
    impacts: np.ndarray
    top: np.ndarray  # largest impact of each term
    block_start: np.ndarray  # blocks of term t
    block_last: np.ndarray  # last item of each block
    block_top: np.ndarray  # largest impact of each block
    longest: int
    questions: list[tuple[int, np.ndarray]]
    answers: list[tuple[int, np.ndarray]]
    slots: np.ndarray  # is there a term with these leading bits


def build_index(items: list[tuple[int, str]]) -> Index | None:
    """Inverted index of (id, text); texts without a term are left out; repeated ids are items of their own."""
    texts = [(i, t, _terms(t)) for i, t in sorted(items)]
    texts = [(i, t, h) for i, t, h in texts if len(h)]
    if not texts:
        return None
    sizes = np.array([len(h) for _, _, h in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    vocabulary, term = np.unique(np.concatenate([h for _, _, h in texts]), return_inverse=True)
    pair, count = np.unique(term.astype(np.int64) * len(texts) + owner, return_counts=True)
    term, owner = pair // len(texts), pair % len(texts)
    holders = np.bincount(term, minlength=len(vocabulary))
    idf = np.log(1 + (len(texts) - holders + 0.5) / (holders + 0.5))
    norm = K1 * (1 - B + B * sizes / sizes.mean())
    impact = idf[term] * count * (K1 + 1) / (count + norm[owner])
    impact /= np.bincount(owner, impact)[owner]
    start = np.concatenate(([0], np.cumsum(holders)))
    top = np.maximum.reduceat(impact, start[:-1])
    blocks = -(-holders // BLOCK)
    block_start = np.concatenate(([0], np.cumsum(blocks)))
    first = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(start[:-1], start[1:])])
    last = np.minimum(first + BLOCK, np.repeat(start[1:], blocks)) - 1
    both = [question_and_answer(t) for _, t, _ in texts]
    slots = np.zeros(1 << _SLOTS, bool)
    slots[(vocabulary >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
    return Index(np.array([i for i, _, _ in texts]), vocabulary, start, owner, impact, top, block_start, owner[last],
                 np.maximum.reduceat(impact, first), int(sizes.max()),
                 [part_shingles(q) for q, _ in both], [part_shingles(a) for _, a in both], slots)


def term_numbers(index: Index, hashes: np.ndarray) -> np.ndarray:
    """Number of each term in the vocabulary, -1 if it is not there."""
    number = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(index.slots[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.vocabulary, hashes[maybe]), len(index.vocabulary) - 1)
    hit = index.vocabulary[place] == hashes[maybe]
    number[maybe[hit]] = place[hit]
    return number


def block_max_wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items whose impacts over the distinct ``terms`` (numbers) sum to the threshold, in item order.

    Cursors move through the postings in item order. The pivot is the first item that could reach the
    threshold by the terms' largest impacts; if the blocks it lies in cannot reach it, the cursors skip
    past the nearest end of these blocks, and no posting in between is read.
    """
    found = []
    at = {int(t): int(index.start[t]) for t in terms}
    ends = {t: int(index.start[t + 1]) for t in at}
    block = {t: int(index.block_start[t]) for t in at}
    items, impacts, top = index.items, index.impacts, index.top
    slack = threshold - 1e-9
    while at:
        order = sorted(at, key=lambda t: items[at[t]])
        bound, pivot = 0.0, None
        for nr, t in enumerate(order):
            bound += top[t]
            if bound >= slack:
                pivot = items[at[t]]
                break
        if pivot is None:
            return found
        while nr + 1 < len(order) and items[at[order[nr + 1]]] == pivot:
            nr += 1
        ahead = order[:nr + 1]
        bound = 0.0
        for t in ahead:  # shallow moves: blocks only
            while index.block_last[block[t]] < pivot and block[t] + 1 < index.block_start[t + 1]:
                block[t] += 1
            if index.block_last[block[t]] >= pivot:
                bound += index.block_top[block[t]]
        if bound < slack:
            limits = [index.block_last[block[t]] + 1 for t in ahead if index.block_last[block[t]] >= pivot]
            target = max(min([*limits, *([items[at[order[nr + 1]]]] if nr + 1 < len(order) else [])]), pivot + 1)
        elif items[at[order[0]]] == pivot:
            score = sum(impacts[at[t]] for t in ahead)
            if score >= slack:
                found.append((int(pivot), float(score)))
            target = pivot + 1
        else:
            target = pivot
        for t in ahead:
            if items[at[t]] < target:
                to = at[t] + int(np.searchsorted(items[at[t]:ends[t]], target))
                if to == ends[t]:
                    del at[t]
                else:
                    at[t] = to
    return found


@dataclass
class Essentials:
    """The postings without which an item cannot reach the threshold, and what its other terms add at most."""
    term: np.ndarray  # is a term essential for some item
    start: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    rest: np.ndarray  # per item


def essentials(index: Index, number: np.ndarray, threshold: float) -> Essentials:
    """Leave out each item's most frequent terms while their impacts stay below a part of the threshold.

    How frequent a term is, is counted in the passages at hand (``number``: their terms); that choice
    decides how many passages are looked at, never which items are found.
    """
    seen = np.bincount(number[number >= 0], minlength=len(index.vocabulary))
    term = np.repeat(np.arange(len(index.vocabulary)), np.diff(index.start))
    order = np.lexsort((term, -seen[term], index.items))
    items, impacts = index.items[order], index.impacts[order]
    sums = np.cumsum(impacts)
    first = np.searchsorted(items, np.arange(len(index.ids)))
    before = np.concatenate(([0.0], sums))[first]
    left_out = sums - before[items] < threshold * LEFT_OUT
    rest = np.bincount(items[left_out], impacts[left_out], minlength=len(index.ids))
    keep = np.zeros(len(order), bool)
    keep[order[~left_out]] = True
    counts = np.bincount(term[keep], minlength=len(index.vocabulary))
    return Essentials(counts > 0, np.concatenate(([0], np.cumsum(counts))), index.items[keep], index.impacts[keep], rest)


def _reachable(index: Index, essential: Essentials, number: np.ndarray, first: np.ndarray, start: np.ndarray,
               owner: np.ndarray, step: int, threshold: float) -> np.ndarray:
    """Passages in which the essential terms of some item, and all its other terms, reach the threshold."""
    at = np.flatnonzero(np.append(essential.term, False)[number])
    if not len(at):
        return at
    text = np.searchsorted(first, at, "right") - 1
    begin = np.searchsorted(owner, np.arange(len(first)))  # first passage of each text
    last = begin[text + 1] - 1
    nr = np.minimum(begin[text] + (at - first[text]) // step, last)
    row = np.concatenate([nr, nr[nr > begin[text]] - 1])
    at = np.concatenate([at, at[nr > begin[text]]])
    term = number[at]
    pairs = np.unique(row * np.int64(len(index.vocabulary)) + term)
    row, term = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    count = essential.start[term + 1] - essential.start[term]
    total = np.cumsum(count)
    place = np.repeat(essential.start[term] - total + count, count) + np.arange(total[-1])
    pairs, inverse = np.unique(np.repeat(row, count) * np.int64(len(index.ids)) + essential.items[place],
                               return_inverse=True)
    sums = np.bincount(inverse, essential.impacts[place]) + essential.rest[pairs % len(index.ids)]
    return np.unique(pairs[sums >= threshold - 1e-6] // len(index.ids))


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, question_share: float,
           answer_share: float, essential: Essentials | None = None) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question share, answer share, first term) of every verified pair.

    Of several passages of a text with one item the best counts: by answer and question share, then the first.
    """
    hashes, first = term_hashes(data, offsets)
    if not len(hashes):
        return []
    number = term_numbers(index, hashes)
    step = index.longest
    if essential is None:
        essential = essentials(index, number, threshold)
    counts = np.maximum(-(-np.diff(first) // step) - 1, 1) * (np.diff(first) > 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    stop = np.minimum(start + 2 * step, first[owner + 1])
    best: dict[tuple[int, int], tuple] = {}
    for row in _reachable(index, essential, number, first, start, owner, step, threshold):
        a, b, text = int(start[row]), int(stop[row]), int(owner[row])
        terms = np.unique(number[a:b])
        terms = terms[terms >= 0]
        around = hashes[max(a - step, int(first[text])):min(b + step, int(first[text + 1]))]
        for item, score in block_max_wand(index, terms, threshold):
            question, answer = (overlap(around, s) for s in (index.questions[item], index.answers[item]))
            if question >= question_share and answer >= answer_share:
                rank = (-answer, -question, a)
                if (text, item) not in best or rank < best[text, item][0]:
                    best[text, item] = (rank, score)
    return [(text, item, score, -rank[1], -rank[0], rank[2] - int(first[text]))
            for (text, item), (rank, score) in sorted(best.items())]


def overlap(around: np.ndarray, part: tuple[int, np.ndarray]) -> float:
    """Share of a part's shingles that stand in ``around`` (terms); an empty part is found everywhere."""
    size, wanted = part
    return float(np.isin(wanted, shingles(around, size)).mean()) if len(wanted) else 1.0


_HITS = "doc_id long, item_id long, score double, question_share double, answer_share double, first_word long"


def _shards(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size, one at a time on the driver."""
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    shard, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if shard and size + len(r["text"]) > limit:
            yield shard
            shard, size = [], 0
        shard.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if shard:
        yield shard


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                 question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document and test item found in it.

    Null or empty texts contain nothing; items without id or text are left out; rows of ``docs`` that
    repeat give repeated rows, rows without doc_id a null doc_id. Extra columns are ignored; without
    items or documents the result is empty. Items longer than others widen the passages of their shard.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_share", pa.float64()), ("answer_share", pa.float64()), ("first_word", pa.int64())])
    spark, out = docs.sparkSession, None
    for shard in _shards(items, shard_bytes):
        index = build_index(shard)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)  # at most a few times shard_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            essential = None
            for whole in batches:
                for batch in tx.slices(whole, "text"):
                    data, offsets = tx.buffers(batch.column("text"))
                    if essential is None:
                        essential = essentials(shared.value, term_numbers(shared.value, term_hashes(data, offsets)[0]),
                                               threshold)
                    hits = search(shared.value, data, offsets, threshold, question_share, answer_share, essential)
                    if hits:
                        ids = batch.column("doc_id").take(pa.array([h[0] for h in hits]))
                        rest = [pa.array([h[i] for h in hits]) for i in range(2, 6)]
                        yield pa.RecordBatch.from_arrays([ids, pa.array(
                            [int(shared.value.ids[h[1]]) for h in hits]), *rest], schema=schema)
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _HITS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _HITS) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                      question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item (see contaminated), without a shuffle; all columns stay."""
    spark, schema = docs.sparkSession, docs.schema
    for shard in _shards(items, shard_bytes):
        index = build_index(shard)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            essential = None
            for whole in batches:
                for batch in tx.slices(whole, "text"):
                    data, offsets = tx.buffers(batch.column("text"))
                    if essential is None:
                        essential = essentials(shared.value, term_numbers(shared.value, term_hashes(data, offsets)[0]),
                                               threshold)
                    keep = np.ones(batch.num_rows, bool)
                    keep[[h[0] for h in search(shared.value, data, offsets, threshold, question_share, answer_share,
                                               essential)]] = False
                    yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
