"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nystrom landmarks.

Kernel: every triple of letters that follow each other within SPAN places is a feature with the weight
DECAY**span (blanks around a unit count as letters), so that "id-iot", "i d i o t" and "idiiot" still share most triples with "idiot". A
string's units are its words without inner punctuation; runs of single letters are one unit.

Training works on the units of labelled texts: landmarks are words and word parts that toxic texts
have far more often, chosen until they cover the toxic texts; Nystrom features of a unit are its kernel
values at the landmarks, whitened; a squared-hinge machine separates the units of clean texts from
the units of each toxic text that hold a landmark; a toxic text without one gives its most toxic unit,
which is chosen anew in every round. A text's probability comes
from its largest unit margin and the number of units above zero.

As the kernel is a dot product over triples, the whole expansion is one weight per triple: scoring a
unit takes a table look-up per triple and does not depend on the number of landmarks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import text as tx
from ratingloom.llm.quality_cnn import chosen, sampled_texts, scored, single_labels

DECAY, SPAN = 0.8, 6
#: Units are looked at through windows of this many bytes, half a window apart.
UNIT = 32
#: Bounds of the training sample: labelled texts of each kind, distinct units of one text, and
#: distinct clean units that the machine is held against.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_UNITS, CLEAN_UNITS = 1500, 3000, 2000, 60_000
LANDMARKS = 120
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]
_KEPT = np.zeros(256, bool)
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): the units of every text in lower case (A-Z and Latin letters).

    ASCII punctuation is taken out of words; two or more single letters in a row are joined. There is
    a blank before and after every unit, texts have one at either end for that.
    """
    data = np.insert(tx.lower(data), np.repeat(offsets, 2), 32)
    offsets = offsets + 2 * np.arange(len(offsets)) + 1
    after = np.concatenate(([False], data[:-1] == 0xC3)) if len(data) else np.zeros(0, bool)
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    keep = _KEPT[data] | _BLANK[data]
    data, offsets = data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
    starts, ends, first = tx.words(data, offsets)
    letters = ends - starts - (data[starts] >= 0xC0) if len(starts) else starts
    single = letters == 1
    join = single[1:] & single[:-1] if len(starts) else np.zeros(0, bool)
    join[first[(first > 0) & (first < len(starts))] - 1] = False  # never across texts
    at = np.flatnonzero(join)
    if len(at):
        gap = np.zeros(len(data) + 1, np.int8)
        np.add.at(gap, ends[at], 1)
        np.add.at(gap, starts[at + 1], -1)
        keep = np.cumsum(gap[:-1]) == 0
        data, offsets = data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
        starts, ends, first = tx.words(data, offsets)
    return data, starts, ends, first


def _windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units with the blanks around them; longer than UNIT, as overlapping windows: (start, length, unit)."""
    starts, ends = starts - 1, ends + 1
    sizes = ends - starts
    counts = np.maximum(-(-(sizes - UNIT) // (UNIT // 2)) + 1, 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nr = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + nr * (UNIT // 2)
    return begin, np.minimum(ends[owner] - begin, UNIT), owner


def _scale(n: int) -> float:
    """Square root of a string's kernel with itself, when its triples differ."""
    total = sum(max(n - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in _GAPS)
    return total ** 0.5 or 1.0


@dataclass
class Machine:
    alphabet: np.ndarray  # byte -> letter number, 0 for bytes outside of the landmarks
    table: np.ndarray  # weight of each triple
    bias: float
    final: np.ndarray  # weights of (largest margin, log1p(units above 0), 1)

    def margins(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), self.bias, np.float64)
        if not len(starts):
            return out
        begin, size, owner = _windows(starts, ends)
        codes = np.append(self.alphabet[data], np.zeros(UNIT, np.int32))
        found = np.zeros(len(begin))
        order = np.argsort(size.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(size[order], np.arange(UNIT + 2))
        for n in range(3, UNIT + 1):
            for at in range(cuts[n], cuts[n + 1], 20000):
                rows = order[at:min(at + 20000, cuts[n + 1])]
                c = codes[begin[rows][:, None] + np.arange(n)]
                total = np.zeros(len(rows), np.float32)
                for a, b in _GAPS:
                    if a + b < n:
                        key = (c[:, :n - a - b] << 12) | (c[:, a:n - b] << 6) | c[:, a + b:]
                        total += np.float32(DECAY ** (a + b + 1)) * self.table[key].sum(axis=1)
                found[rows] = total / _scale(n)
        best = np.full(len(starts), -np.inf)
        np.maximum.at(best, owner, found)
        return best + self.bias

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(largest margin, log1p(units above 0), 1) of every text; without units as one far below."""
        clean, starts, ends, first = units(data, offsets)
        margin = self.margins(clean, starts, ends)
        top = np.full(len(offsets) - 1, self.bias)
        full = np.flatnonzero(first[1:] > first[:-1])
        count = np.zeros(len(top))
        if len(full):
            top[full] = np.maximum.reduceat(margin, first[full])
            count[full] = np.add.reduceat((margin > 0).astype(float), first[full])
        return np.column_stack([top, np.log1p(count), np.ones(len(top))])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(self.features(data, offsets) @ self.final)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _padded(unit: bytes) -> bytes:
    return b" " + unit[:UNIT - 2] + b" "


def _parts(unit: bytes) -> set[bytes]:
    """The unit and its parts of 4 to 7 bytes, with the blanks around it."""
    word = _padded(unit)
    return {word} | {word[i:i + n] for n in (4, 5, 6, 7) for i in range(len(word) - n + 1)}


def choose_landmarks(texts: list[set[bytes]], toxic: np.ndarray, limit: int = LANDMARKS) -> list[bytes]:
    """Strings by which toxic texts differ, each chosen for toxic texts that the earlier ones left.

    Ties go to the longer, then to the smaller string.
    """
    counts: Counter = Counter()
    for words, y in zip(texts, toxic):
        if y:
            counts.update({p for w in words for p in _parts(w)})
    in_clean = dict.fromkeys((p for p, k in counts.items() if k > 1), 0)
    for words, y in zip(texts, toxic):
        if not y:
            for p in {p for w in words for p in _parts(w) if p in in_clean}:
                in_clean[p] += 1
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    usable = set()
    for p, k in in_clean.items():  # far more often than by chance
        chance = n_toxic * (k + 1) / n_clean
        if counts[p] >= chance + 4 * chance ** 0.5 + 2:
            usable.add(p)
    covers = [{p for w in words for p in _parts(w) if p in usable} for words, y in zip(texts, toxic) if y]
    chosen: list[bytes] = []
    for times in (1, 2, 3):  # cover every toxic text up to three times
        left = [p.difference(chosen) for p in covers]
        while len(chosen) < limit * times // 3:
            counts = Counter()
            for p in left:
                counts.update(p)
            best = max(counts, key=lambda s: (counts[s] * _rise(counts[s], n_toxic, in_clean[s], n_clean), len(s), s),
                       default=None)
            if best is None or counts[best] < 2:
                break
            chosen.append(best)
            left = [p for p in left if best not in p]
    return chosen


def _rise(k: int, n: int, k0: int, n0: int) -> float:
    return float(np.log((k / n) / ((k0 + 1) / n0)))


def train_machine(texts: list[set[bytes]], toxic: np.ndarray, weights: np.ndarray, rounds: int = 4) -> Machine:
    """``texts``: the distinct units of each; ``weights``: texts of the corpus that a text stands for."""
    landmarks = choose_landmarks(texts, toxic)
    used = Counter(b for s in landmarks for b in s)
    alphabet = np.zeros(256, np.int32)
    for nr, b in enumerate(sorted(set(used) - {32}, key=lambda b: (-used[b], b))[:62], 1):
        alphabet[b] = nr
    alphabet[_BLANK] = 63
    empty = Machine(alphabet, np.zeros(1 << 18, np.float32), 0.0, np.array([0.0, 0.0, -4.6]))
    if not landmarks or toxic.all():
        return empty
    maps = np.zeros((len(landmarks), 1 << 18), np.float32)
    for row, s in enumerate(landmarks):
        c = alphabet[np.frombuffer(s, np.uint8)]
        for a, b in _GAPS:
            if a + b < len(c):
                key = (c[:len(c) - a - b] << 12) | (c[a:len(c) - b] << 6) | c[a + b:]
                np.add.at(maps[row], key, DECAY ** (a + b + 1) / _scale(len(c)))
    live = np.flatnonzero(maps.any(axis=0))
    live = live[(live & 63 > 0) & (live >> 6 & 63 > 0) & (live >> 12 > 0)]  # triples of landmark letters only
    dense = maps[:, live].astype(np.float64)
    gram = dense @ dense.T
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6))  # landmark kernel values -> Nystrom features
    lookup = np.full(1 << 18, -1, np.int32)
    lookup[live] = np.arange(len(live))
    projected = np.vstack([dense.T @ whiten, np.zeros(len(landmarks))])  # per triple; last row: not live

    toxic_texts = [[w for w in t if len(w) >= 3] for t, y in zip(texts, toxic) if y]
    clean = {w for t, y in zip(texts, toxic) if not y for w in t if len(w) >= 3}
    clean = _hardest(sorted(clean, key=lambda w: (zlib.crc32(w), w)), Machine(alphabet, maps.sum(axis=0), 0.0, empty.final))
    distinct = sorted({w for t in toxic_texts for w in t} | set(clean))
    number = {w: i for i, w in enumerate(distinct)}
    x = _nystrom(distinct, alphabet, lookup, projected)
    clean_units = np.array(sorted(number[w] for w in clean), int)
    bags = [np.array([number[w] for w in t], int) for t in toxic_texts if t]
    del distinct, maps, dense
    if not bags or not len(clean_units):
        return empty
    score = np.linalg.norm(x, axis=1)
    marked = np.zeros(len(x), bool)
    for t in toxic_texts:
        for unit in t:
            if any(s in _padded(unit) for s in landmarks):
                marked[number[unit]] = True
    del number
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        top = np.concatenate([b[marked[b]] if marked[b].any() else b[[np.argmax(score[b])]] for b in bags])
        rows = np.concatenate([top, clean_units])
        y = np.concatenate([np.ones(len(top)), -np.ones(len(clean_units))])
        share = np.concatenate([np.full(len(top), 1 / len(top)), np.full(len(clean_units), 40 / len(clean_units))])
        w, bias = _squared_hinge(x[rows], y, share)
        score = x @ w + bias
    table = np.zeros(1 << 18, np.float32)
    table[live] = projected[:-1] @ w
    machine = Machine(alphabet, table, float(bias), empty.final)
    feats = []
    for t in texts:
        joined = b"\n".join(sorted(t))  # units are put between blanks again
        feats.append(machine.features(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0])
    machine.final = _logistic(np.array(feats), toxic.astype(float), weights)
    return machine


def _hardest(strings: list[bytes], near: Machine) -> list[bytes]:
    """At most CLEAN_UNITS of ``strings``: the half nearest to the landmarks, the rest by their order."""
    if len(strings) <= CLEAN_UNITS:
        return strings
    joined = b" " + b" ".join(strings) + b" "
    ends = np.cumsum([len(s) + 1 for s in strings])
    starts = ends - [len(s) for s in strings]
    rank = np.argsort(-near.margins(np.frombuffer(joined, np.uint8), starts, ends), kind="stable")
    top = rank[:CLEAN_UNITS // 2]
    rest = np.setdiff1d(np.arange(len(strings)), top)[:CLEAN_UNITS - len(top)]
    return [strings[i] for i in np.concatenate([top, rest])]


def _nystrom(strings: list[bytes], alphabet: np.ndarray, lookup: np.ndarray, projected: np.ndarray) -> np.ndarray:
    out = np.zeros((len(strings), projected.shape[1]), np.float32)
    projected = projected.astype(np.float32)
    strings = [_padded(s) for s in strings]
    sizes = np.array([len(s) for s in strings], int)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        for at in range(0, len(rows), 2000):
            some = rows[at:at + 2000]
            c = alphabet[np.frombuffer(b"".join(strings[i] for i in some), np.uint8).reshape(-1, n)]
            for a, b in _GAPS:
                if a + b < n:
                    key = lookup[(c[:, :n - a - b] << 12) | (c[:, a:n - b] << 6) | c[:, a + b:]]
                    r, k = np.nonzero(key >= 0)
                    np.add.at(out, some[r], np.float32(DECAY ** (a + b + 1) / _scale(n)) * projected[key[r, k]])
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Newton steps on penalty/2 |w|^2 + sum share * max(0, 1 - y f)^2 / 2."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], penalty)
    reg[-1] = 1e-8
    for _ in range(30):
        slack = 1 - y * (z @ w)
        on = slack > 0
        grad = reg * w - (share[on] * slack[on] * y[on]) @ z[on]
        hess = (z[on] * share[on, None]).T @ z[on] + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    weights = weights / weights.mean()
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (weights * (p - y)) + penalty * len(y) * w
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), n_toxic: int = TRAIN_TOXIC,
          n_clean: int = TRAIN_CLEAN) -> Machine:
    """Fit a machine on a bounded sample: n_toxic and n_clean labelled texts, TRAIN_UNITS units of each.

    Without toxic labels outside of the held-out fold every text gets 0.01.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("units", pa.binary())])

    def cut(batches):
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                data, starts, ends, first = units(*tx.buffers(batch.column("text")))
                raw, found = data.tobytes(), []
                for a, b in zip(first[:-1], first[1:]):
                    own = sorted({raw[s:e] for s, e in zip(starts[a:b], ends[a:b])})
                    found.append(b"\n".join(own[::max(1, -(-len(own) // TRAIN_UNITS))]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], schema=schema)
    known = single_labels(labels.filter("toxic IN (0, 1)"), "toxic", fold)
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = chosen(known.filter("y = 1"), "toxic", n_toxic).unionByName(chosen(known.filter("y = 0"), "toxic", n_clean))
    rows = sampled_texts(docs, sample).mapInArrow(
        cut, "doc_id long, y int, units binary").toPandas().sort_values(["doc_id", "y", "units"])
    toxic = rows["y"].to_numpy() == 1
    texts = [set(bytes(u).split(b"\n")) - {b""} for u in rows["units"]]
    count = np.where(toxic, max(toxic.sum(), 1), max((~toxic).sum(), 1))
    weights = np.where(toxic, total.get(1, 0), total.get(0, 0)) / count
    return train_machine(texts, toxic, weights)


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every row of ``docs``; null or empty text has no units and scores low."""
    context = docs.sparkSession.sparkContext.broadcast(machine)  # one weight per triple: about 1 MB
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                scores = context.value.score(*tx.buffers(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(score_texts(docs, machine), (3, 1))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
