"""Token ids of whole Arrow columns with a public byte-level BPE vocabulary.

BPE works on the pieces of a fixed pattern, so each distinct piece is encoded once and remembered
(bounded); the pieces of a batch are found and counted in numpy. Texts with letters outside of the
Latin blocks or with a special token go to the tokenizer as a whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from ratingloom.llm import text as tx

_LATIN = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: Pieces that are kept in memory per worker process, about 30 bytes each.
REMEMBERED = 1_000_000


@functools.cache
def _classes() -> np.ndarray:
    kinds = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]
    return np.array([next((i for i, k in enumerate(kinds) if k.match(chr(c))), _OTHER) for c in range(_LATIN)], np.uint8)


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+ begin.

    ``points``: code points below _LATIN; ``offsets``: the texts, which pieces never cross.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = edge[:-1]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = change | first  # of runs of one kind
    space = kind == _SPACE
    word = begin & ~space
    absorbed = np.zeros(n, bool)
    absorbed[1:] = word[1:] & ~first[1:] & (points[:-1] == 32)
    start = begin & ~absorbed
    # the last of several spaces before a word is a piece of its own, or goes with the word
    before = np.flatnonzero(word & ~first)
    before = before[space[before - 1]]
    start[before - 1] = True
    # contractions
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        # the end of the text of each quote
        stop = offsets[np.searchsorted(offsets, quote, "right")]
        at = lambda k: np.where(quote + k < stop, points[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for mask, size in ((short, 2), (long & ~short, 3)):
            q, s = quote[mask], stop[mask]
            start[q + 1] = False
            nxt = q + size
            ok = nxt < s
            start[nxt[ok & (kind[np.minimum(nxt, n - 1)] == _LETTER)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts; use one per process (``encoder(path)``)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, counts = [], []
        for at in range(0, len(pieces), 1000):
            some = pieces[at:at + 1000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        where = len(self.ids) + np.cumsum(counts) - counts
        order = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, place, hashes[order])
        self.where = np.insert(self.where, place, where[order])
        self.count = np.insert(self.count, place, counts[order])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null is empty."""
        data, offsets = tx.buffers(column)
        wide = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data >= 0xC9, out=wide[1:])  # first byte of U+0240 and above
        plain = wide[offsets[1:]] == wide[offsets[:-1]]
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(token, at + 1)
        if plain.all():
            return self._fast(raw, data, offsets)
        parts, sizes = [], np.zeros(len(plain), np.int64)
        rows = np.flatnonzero(plain)
        some, cut = self._fast(b"".join(raw[offsets[i]:offsets[i + 1]] for i in rows), None, np.concatenate(
            ([0], np.cumsum(np.diff(offsets)[rows]))))
        sizes[rows] = np.diff(cut)
        fast = dict(zip(rows.tolist(), range(len(rows))))
        for i in range(len(plain)):
            if i in fast:
                parts.append(some[cut[fast[i]]:cut[fast[i] + 1]])
            else:
                text = raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace")
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                sizes[i] = len(parts[-1])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))

    def _fast(self, raw: bytes, data: np.ndarray | None, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8) if data is None else data
        leading = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leading[1:])
        cuts = leading[offsets]
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, cuts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(points))
        hashes = tx.Rolling(points.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15), "byte").of(starts, ends)
        code, distinct = pd.factorize(hashes)
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            seen = np.zeros(len(distinct), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]  # the first piece of each
            at = seen[new]
            self._learn(distinct[new], [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            place = np.searchsorted(self.known, distinct)
        count, where = self.count[place][code], self.where[place][code]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(where - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, cuts)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
