"""Best items per user for scores that are dense over users x items, without meeting all of them.

Users and items are ordered by the feature that weighs most in them and cut into blocks, so that a block holds similar
rows. A summary of an item block (largest and smallest value of each feature, largest bonus, middle and radius of the
factor vectors) bounds what any of its items can score for a user. First every user meets the block with the largest
bound; the score that a user's k-th item has then is a threshold, and only the pairs of a user and a block whose bound
reaches it are scored. The result is exact. Summaries meet user blocks like items do, in groups of bounded size.

In a task, vectors are laid out densely over the features that occur in it, part by part, and multiplied as matrices; an
item that many users of the block love is multiplied once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import dense_index, top_per_group
from ..session import durable

#: Summaries that meet a user block in one task; blocks that every user meets first; numbers in a dense part.
SUMMARIES, FIRST_BLOCKS, CELLS = 64, 1, 1 << 21
#: Bounds are compared with this much room, as sums of doubles differ in their last bits.
ROOM = 1e-8

_USER, _ITEM, _LOVED, _LINK, _CF, _SEEN, _FIRST = range(7)
_ROW = ("kind int, user_id bigint, item_id bigint, idx array<int>, val array<double>, under array<double>, "
        "vec array<double>, num double, low double, high double")


def _rows(df: DataFrame, kind: int, *keys: str) -> DataFrame:
    """``df`` in the columns of _ROW, with the group's keys; missing ones are null."""
    types = [c.split(" ") for c in _ROW.split(", ")]
    have = {"kind": F.lit(kind)} | {n: F.col(n) for n, _ in types if n in df.columns}
    return df.select(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in types], *keys)


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Sparse:
    """Sparse vectors of a task: the entries of all rows in a line."""

    def __init__(self, idx, val):
        self.sizes = np.array([0 if x is None else len(x) for x in idx], np.int64)
        join = lambda xs, kind: np.concatenate([np.asarray(x, kind) for x in xs if x is not None and len(x)] or [np.zeros(0, kind)])
        self.idx, self.val = join(idx, np.int64), join(val, float)
        self.ends = np.cumsum(self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def span(self, lo: int, hi: int) -> slice:
        return slice(int(self.ends[lo] - self.sizes[lo]), int(self.ends[hi - 1]))

    def dense(self, lo: int, hi: int, names: np.ndarray, val: np.ndarray | None = None) -> np.ndarray:
        """Rows [lo, hi) over the features ``names`` (ascending); other features are left out."""
        out = np.zeros((hi - lo, len(names)))
        if hi > lo and len(names):
            span = self.span(lo, hi)
            at = np.minimum(np.searchsorted(names, self.idx[span]), len(names) - 1)
            known = names[at] == self.idx[span]
            row = np.repeat(np.arange(hi - lo), self.sizes[lo:hi])
            out[row[known], at[known]] = (self.val if val is None else val)[span][known]
        return out


class Table:
    """Sparse rows cut into parts that are small when dense; products with other rows are matrix products."""

    def __init__(self, rows: Sparse, under: np.ndarray | None = None):
        self.rows, self.under, self.parts = rows, under, []
        todo = [(0, len(rows))] if len(rows) else []
        while todo:
            lo, hi = todo.pop()
            names = np.unique(rows.idx[rows.span(lo, hi)])
            if hi - lo > 1 and (hi - lo) * len(names) > CELLS:
                middle = (lo + hi) // 2
                todo += [(lo, middle), (middle, hi)]
            else:
                self.parts.append((lo, hi, names, rows.dense(lo, hi, names), None if under is None else rows.dense(lo, hi, names, under)))

    def times(self, queries: Sparse, lo: int, hi: int, least: bool = False) -> np.ndarray:
        """Products of the queries [lo, hi) with all rows; with two values a feature the largest (or ``least``) possible one."""
        out = np.zeros((hi - lo, len(self.rows)))
        for a, b, names, most, under in self.parts:
            step = max(1, CELLS // max(len(names), 1))
            for x in range(lo, hi, step):
                y = min(x + step, hi)
                q = queries.dense(x, y, names)
                if under is None:
                    out[x - lo:y - lo, a:b] = q @ most.T
                else:
                    up, down = (under, most) if least else (most, under)
                    out[x - lo:y - lo, a:b] = np.maximum(q, 0) @ up.T + np.minimum(q, 0) @ down.T
        return out


def _loved(frame: dict, users: pd.DataFrame, table: Table, clip: bool) -> tuple[np.ndarray, np.ndarray]:
    """(largest product of each user's loved items with every row, users that love some)."""
    best, some = np.zeros((len(users), len(table.rows))), np.zeros(len(users), bool)
    loved, links = frame.get(_LOVED), frame.get(_LINK)
    if loved is None or links is None:
        return best, some
    loved = loved.drop_duplicates("item_id")
    vectors, place = Sparse(loved["idx"], loved["val"]), {i: n for n, i in enumerate(loved["item_id"])}
    row = {u: n for n, u in enumerate(users["user_id"])}
    pairs = sorted((place[i], row[u]) for u, i in zip(links["user_id"], links["item_id"]) if i in place and u in row)
    step, at = max(1, CELLS // max(len(table.rows), 1)), 0
    for lo in range(0, len(vectors), step):
        part = table.times(vectors, lo, min(lo + step, len(vectors)))
        if clip:
            np.minimum(part, 1.0, out=part)
        while at < len(pairs) and pairs[at][0] < lo + step:
            item, user = pairs[at]
            best[user] = np.maximum(best[user], part[item - lo]) if some[user] else part[item - lo]
            some[user], at = True, at + 1
    return best, some


def _frames(pdf: pd.DataFrame) -> dict[int, pd.DataFrame]:
    return {k: g for k, g in pdf.groupby("kind")}


def _stacked(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the rows that have a vector, which rows these are)."""
    there = column.notna().to_numpy()
    return (np.array(column[there].tolist()) if there.any() else np.zeros((0, 0))), there


_BOUND = "user_id bigint, ub bigint, ib bigint, bound double"


def _bounder(blend, first: bool, best: int | None):
    """Task function for a user block and a group of summaries: the ``best`` blocks per user, or all that reach its num."""
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = _frames(pdf)
        none = pd.DataFrame({"user_id": [], "ub": [], "ib": [], "bound": []})
        if _USER not in kinds or _ITEM not in kinds:
            return none
        users, items = kinds[_USER].reset_index(drop=True), kinds[_ITEM].sort_values("item_id")
        ids = items["item_id"].to_numpy(np.int64)
        packed = Sparse(items["idx"], items["val"])
        table = Table(packed, Sparse(items["idx"], items["under"]).val)
        people, has = Sparse(users["idx"], users["val"]), users["idx"].notna().to_numpy()
        total = np.tile(items["num"].to_numpy(float), (len(users), 1))
        content = np.minimum(table.times(people, 0, len(users)), 1.0)
        love, some = _loved(kinds, users, table, True)
        content += np.where(some[:, None], blend.love * love, 0.0)
        total[has] += blend.beta * content[has]
        if blend.gamma and users["vec"].notna().any() and items["vec"].notna().any():
            mine, there = _stacked(users["vec"])
            middle, known = _stacked(items["vec"])
            top = mine @ middle.T + np.linalg.norm(mine, axis=1)[:, None] * items["low"].to_numpy(float)[known][None]
            low, high = (users[c].to_numpy(float)[there][:, None] for c in ("low", "high"))
            part = (np.minimum(top, high) - low) / (high - low + 1e-8)
            total[np.ix_(there, known)] += blend.gamma * np.maximum(part, 0.0) if blend.gamma > 0 else 0.0
        if _CF in kinds:
            row = {u: n for n, u in enumerate(users["user_id"])}
            g = kinds[_CF][kinds[_CF]["user_id"].isin(row)]
            at = [row[u] for u in g["user_id"]], np.searchsorted(ids, g["item_id"].to_numpy(np.int64))
            total[at] += max(blend.alpha, 0.0) * np.maximum(g["num"].to_numpy(float), 0.0)
        if first:
            lead = kinds.get(_FIRST, pdf.iloc[:0]).set_index("user_id")
            known = users["user_id"].isin(lead.index).to_numpy()
            vectors = lead.reindex(users["user_id"])
            near = table.times(Sparse([x if isinstance(x, (list, np.ndarray)) else None for x in vectors["idx"]],
                                      [x if isinstance(x, (list, np.ndarray)) else None for x in vectors["val"]]), 0, len(users), True)
            total = np.where(known[:, None], 0.7 * total + 0.3 * (1.0 - near), -np.inf)
        least = users["num"].fillna(-np.inf).to_numpy(float)
        if best is not None and len(ids) > best:
            order = np.lexsort((np.tile(ids, (len(users), 1)), -total), axis=1)[:, :best]
            row, col = np.repeat(np.arange(len(users)), best), order.ravel()
        else:
            row, col = np.nonzero(total >= least[:, None] - ROOM)
        row, col = row[np.isfinite(total[row, col])], col[np.isfinite(total[row, col])]
        return pd.DataFrame({"user_id": users["user_id"].to_numpy(np.int64)[row], "ub": int(keys[0]), "ib": ids[col], "bound": total[row, col]})

    return run


FOUND = "user_id bigint, item_id bigint, score double, key double"


def _scorer(blend, keep: int, first: bool):
    """Task function for some users of a block and an item block: the best ``keep`` unseen items per user."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = _frames(pdf)
        none = pd.DataFrame({"user_id": [], "item_id": [], "score": [], "key": []})
        if _USER not in kinds or _ITEM not in kinds:
            return none
        users, items = kinds[_USER].reset_index(drop=True), kinds[_ITEM].sort_values("item_id")
        ids, row = items["item_id"].to_numpy(np.int64), {u: n for n, u in enumerate(users["user_id"])}
        table = Table(Sparse(items["idx"], items["val"]))
        has = users["idx"].notna().to_numpy()
        content = table.times(Sparse(users["idx"], users["val"]), 0, len(users))
        if blend.love:
            love, some = _loved(kinds, users, table, False)
            content += np.where(some[:, None], blend.love * love, 0.0)
        total = np.tile(items["num"].to_numpy(float), (len(users), 1))
        total[has] += blend.beta * content[has]
        if blend.gamma and users["vec"].notna().any() and items["vec"].notna().all():
            mine, there = _stacked(users["vec"])
            raw = mine @ np.array(items["vec"].tolist()).T
            low, high = (users[c].to_numpy(float)[there][:, None] for c in ("low", "high"))
            total[there] += blend.gamma * (raw - low) / (high - low + 1e-8)
        open_ = np.ones(total.shape, bool)
        for kind in (_CF, _SEEN):
            if kind in kinds:
                g = kinds[kind]
                at = [row[u] for u in g["user_id"]], np.searchsorted(ids, g["item_id"].to_numpy(np.int64))
                if kind == _CF:
                    total[at] += blend.alpha * g["num"].to_numpy(float)
                else:
                    open_[at] = False
        total = np.floor(total * 1e9 + 0.5) / 1e9
        key = total
        if first:
            lead = kinds.get(_FIRST, pdf.iloc[:0]).set_index("user_id").reindex(users["user_id"])
            known = lead["item_id"].notna().to_numpy()
            open_ &= known[:, None] & (ids[None] != lead["item_id"].fillna(-1).to_numpy(np.int64)[:, None])
            pick = lambda name: [x if isinstance(x, (list, np.ndarray)) else None for x in lead[name]]
            key = 0.7 * total + 0.3 * (1.0 - table.times(Sparse(pick("idx"), pick("val")), 0, len(users)))
        out = []
        for n, user in enumerate(users["user_id"]):
            at = np.flatnonzero(open_[n])
            if len(at) > keep:
                mine = key[n, at]
                at = at[mine >= np.partition(mine, len(at) - keep)[len(at) - keep]]
            best = at[np.lexsort((ids[at], -key[n, at]))[:keep]]
            out.append((np.full(len(best), user), ids[best], total[n, best], key[n, best]))
        return pd.DataFrame(dict(zip(("user_id", "item_id", "score", "key"), map(np.concatenate, zip(*out)))))

    return run


@dataclass
class Blocks:
    """Written tables of the users, the items and what links them, each with its block numbers."""

    people: DataFrame  # ub, user_id, idx, val, and vec, low, high where factors count
    items: DataFrame  # ib, item_id, idx, val, num, and vec
    summaries: DataFrame  # ib, idx, val, under, num, and vec, low
    loved: DataFrame  # ub, item_id, idx, val
    links: DataFrame  # ub, user_id, item_id
    cf: DataFrame  # ub, ib, user_id, item_id, num
    seen: DataFrame  # ub, ib, user_id, item_id
    vectors: DataFrame  # item_id, idx, val
    user_blocks: int
    item_blocks: int


def _numbered(rows: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """(key, block number) with at most ``size`` rows a block, ordered by the feature that weighs most; number of blocks."""
    n = rows.count()
    if n <= size:
        return rows.select(key, F.lit(0).cast("bigint").alias(name)), 1
    lead = F.coalesce(F.get("idx", (F.array_position("val", F.array_max("val")) - 1).cast("int")), F.lit(-1))
    index = dense_index(rows.select(key, lead.alias("lead")), ["lead", key], "pos")
    return durable(index.select(key, F.floor(F.col("pos") / size).alias(name))), -(-n // size)


def _summaries(items: DataFrame, factors: bool) -> DataFrame:
    size = items.groupBy("ib").agg(F.count(F.lit(1)).alias("size"), F.max("num").alias("num"))
    entry = items.select("ib", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("ib", F.col("e.idx").alias("f"), F.col("e.val").alias("v"))
    each = entry.groupBy("ib", "f").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.count(F.lit(1)).alias("n")).join(
        size.select("ib", "size"), "ib")
    # an item without the feature has 0 there
    whole = F.col("n") == F.col("size")
    hi, lo = F.when(whole, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))), F.when(whole, F.col("lo")).otherwise(F.least("lo", F.lit(0.0)))
    packed = each.groupBy("ib").agg(F.array_sort(F.collect_list(F.struct("f", hi.alias("hi"), lo.alias("lo")))).alias("e"))
    out = size.join(packed, "ib", "left").select(
        "ib", "num", *[F.coalesce(F.col(f"e.{c}").cast(f"array<{t}>"), F.array().cast(f"array<{t}>")).alias(n)
                       for c, t, n in (("f", "int", "idx"), ("hi", "double", "val"), ("lo", "double", "under"))])
    if factors:
        middle = durable(items.filter("vec IS NOT NULL").groupBy("ib").agg(
            vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("middle")))
        gap = F.aggregate(F.zip_with("vec", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        far = items.filter("vec IS NOT NULL").join(middle, "ib").groupBy("ib").agg(F.max(F.sqrt(gap)).alias("low"))
        out = out.join(middle.withColumnRenamed("middle", "vec").join(far, "ib"), "ib", "left")
    return out


def build_blocks(parts, users: DataFrame, blend, users_per_block: int, items_per_block: int, ranges: DataFrame | None = None) -> Blocks:
    """Block tables for ``users`` (user_id) under a blend; ``ranges`` (id, low, high) are those of the factor products."""
    extra = F.lit(blend.quality) * F.col("quality") + (F.col("explore") if blend.explore else F.lit(0.0))
    items = parts.vectors.join(parts.bonus, "item_id", "left").fillna(0.0, ["quality", "explore"]).select("item_id", "idx", "val", extra.alias("num"))
    people = users.select("user_id").distinct().join(parts.profiles, "user_id", "left")
    if ranges is not None:
        items = items.join(parts.item_factors.withColumnRenamed("id", "item_id"), "item_id", "left")
        people = people.join(parts.user_factors.join(ranges, "id").withColumnRenamed("id", "user_id"), "user_id", "left")
    people, items = durable(people), durable(items)
    ub, user_blocks = _numbered(people, "user_id", users_per_block, "ub")
    ib, item_blocks = _numbered(items, "item_id", items_per_block, "ib")
    people, items = durable(people.join(ub, "user_id")), durable(items.join(ib, "item_id"))
    vectors = items.select("item_id", "idx", "val")
    links = durable(parts.loved.join(ub, "user_id").select("ub", "user_id", "item_id"))
    loved = durable(links.select("ub", "item_id").distinct().join(vectors, "item_id"))

    def pairs(df: DataFrame, *cols: str | Column) -> DataFrame:
        return durable(df.join(ub, "user_id").join(ib, "item_id").select("ub", "ib", "user_id", "item_id", *cols))
    return Blocks(people, items, durable(_summaries(items, ranges is not None)), loved, links,
                  pairs(parts.cf, F.col("cf").alias("num")), pairs(parts.seen), vectors, user_blocks, item_blocks)


def _bounds(blocks: Blocks, blend, users: DataFrame, best: int | None, first: DataFrame | None) -> DataFrame:
    """(user_id, ub, ib, bound) for ``users`` (user_id, num: what a bound must reach)."""
    groups = -(-blocks.item_blocks // SUMMARIES)
    cb = F.floor(F.col("ib") / SUMMARIES).alias("cb")
    all_cb, all_ub = (F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")) for n in (groups, blocks.user_blocks))
    mine = blocks.people.join(users, "user_id").withColumn("cb", all_cb)
    summary = blocks.summaries.withColumnRenamed("ib", "item_id").withColumn("ib", F.col("item_id")).withColumn("cb", cb).withColumn("ub", all_ub)
    frames = [_rows(mine, _USER, "ub", "cb"), _rows(summary, _ITEM, "ub", "cb")]
    if blend.love:
        frames += [_rows(blocks.loved.withColumn("cb", all_cb), _LOVED, "ub", "cb"),
                   _rows(blocks.links.withColumn("cb", all_cb), _LINK, "ub", "cb")]
    if blend.alpha:
        most = blocks.cf.groupBy("ub", "ib", "user_id").agg(F.max("num").alias("num")).select(
            "ub", cb, "user_id", F.col("ib").alias("item_id"), "num")
        frames.append(_rows(most, _CF, "ub", "cb"))
    if first is not None:
        frames.append(_rows(first.join(blocks.people.select("user_id", "ub"), "user_id").withColumn("cb", all_cb), _FIRST, "ub", "cb"))
    return _together(frames).groupBy("ub", "cb").applyInPandas(_bounder(blend, first is not None, best), _BOUND)


def _scores(blocks: Blocks, blend, pairs: DataFrame, keep: int, first: DataFrame | None) -> DataFrame:
    """The best ``keep`` items of every pair of a user and an item block in ``pairs`` (user_id, ub, ib)."""
    groups = pairs.select("ub", "ib").distinct()
    of_user = lambda df, *cols: pairs.join(df.drop("ub"), ["user_id", *cols])
    frames = [_rows(of_user(blocks.people), _USER, "ub", "ib"), _rows(groups.join(blocks.items, "ib"), _ITEM, "ub", "ib"),
              _rows(of_user(blocks.seen, "ib"), _SEEN, "ub", "ib")]
    if blend.love:
        frames += [_rows(groups.join(blocks.loved, "ub"), _LOVED, "ub", "ib"), _rows(of_user(blocks.links), _LINK, "ub", "ib")]
    if blend.alpha:
        frames.append(_rows(of_user(blocks.cf, "ib"), _CF, "ub", "ib"))
    if first is not None:
        frames.append(_rows(of_user(first), _FIRST, "ub", "ib"))
    return _together(frames).groupBy("ub", "ib").applyInPandas(_scorer(blend, keep, first is not None), FOUND)


def rounds(blocks: Blocks, blend, keep: int, users: DataFrame | None = None, lead: DataFrame | None = None
           ) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(found rows, pairs of user and block that were scored) of the first round and, if there are more blocks, of the second."""
    who = blocks.people.select("user_id")
    if users is not None:
        who = who.join(users, "user_id", "left_semi")
    first = None if lead is None else durable(lead.select("user_id", "item_id").join(blocks.vectors, "item_id"))
    start = _bounds(blocks, blend, who.withColumn("num", F.lit(None).cast("double")), FIRST_BLOCKS, first)
    pairs = durable(top_per_group(start, "user_id", [F.desc("bound"), F.asc("ib")], FIRST_BLOCKS).select("user_id", "ub", "ib"))
    found = durable(_scores(blocks, blend, pairs, keep, first))
    yield found, pairs
    if blocks.item_blocks > FIRST_BLOCKS:
        kth = top_per_group(found, "user_id", [F.desc("key"), F.asc("item_id")], keep).filter(F.col("rank") == keep)
        todo = who.join(kth.select("user_id", F.col("key").alias("num")), "user_id", "left")
        more = _bounds(blocks, blend, todo, None, first).select("user_id", "ub", "ib").join(pairs, ["user_id", "ib"], "left_anti")
        more = durable(more.select("user_id", "ub", "ib"))
        yield durable(_scores(blocks, blend, more, keep, first)), more


def best_items(blocks: Blocks, blend, keep: int, users: DataFrame | None = None, lead: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, key, rank): the ``keep`` unseen items with the largest key per user; ties by item.

    The key is the score; with ``lead`` (user_id, item_id) it is 0.7 score + 0.3 (1 - cosine to that item), which itself
    is left out.
    """
    found = _together([rows for rows, _ in rounds(blocks, blend, keep, users, lead)])
    return top_per_group(found, "user_id", [F.desc("key"), F.asc("item_id")], keep)
