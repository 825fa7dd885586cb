from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from data import frame, interactions
from ratingloom.functions import skew
from ratingloom.operators.pairs import matched_pairs, matched_rows

ROWS = interactions(rows=200)


def test_heavy_keys_are_found(spark, tiny_limits):
    assert 1 in skew.heavy_keys(frame(spark, ROWS), "user_id")


def test_number_in_group_matches_a_plain_rank(spark, tiny_limits):
    got = skew.number_in_group(frame(spark, ROWS), "user_id", ["ts", "row_key"]).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[0]].append((r[3], r[4]))
    assert len(got) == len(ROWS)
    for r in got:
        order = sorted(groups[r["user_id"]])
        assert order[r["pos"] - 1] == (r["ts"], r["row_key"]) and r["n"] == len(order)


def test_running_sum_matches_python(spark, tiny_limits):
    df = frame(spark, ROWS).withColumn("v", F.col("rating").cast("bigint"))
    got = {r["row_key"]: r["s"] for r in skew.running_sum(df, "user_id", ["ts", "row_key"], "v", "s").collect()}
    total = Counter()
    for r in sorted(ROWS, key=lambda r: (r[3], r[4])):
        total[r[0]] += int(r[2])
        assert got[r[4]] == total[r[0]]


def test_lookup_join_salted_equals_plain(spark, tiny_limits):
    df = frame(spark, ROWS)
    table = df.groupBy("item_id").agg(F.count("*").alias("n")).filter("item_id <> 2")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(tuple, df.join(table, "item_id", how).select("row_key").collect()))
        salted = skew.lookup_join(df, table, "item_id", how, skew.heavy_keys(df, "item_id"))
        assert sorted(map(tuple, salted.select("row_key").collect())) == plain


def test_lookup_join_with_text_and_missing_keys(spark, tiny_limits):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 7}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i long")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("other", 4), (None, 5)], "k string, v long")
    heavy = skew.heavy_keys(df, "k")
    assert heavy.salts["hot"] > 2 == min(heavy.salts.values())
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = df.join(table, "k", how)
        salted = skew.lookup_join(df, table, "k", how, heavy)
        assert salted.columns == plain.columns
        assert Counter(map(tuple, salted.collect())) == Counter(map(tuple, plain.collect()))


def test_dense_index_is_the_sorted_position(spark, tiny_limits):
    got = {r["row_key"]: r["idx"] for r in skew.dense_index(frame(spark, ROWS), ["ts", "row_key"]).collect()}
    for i, r in enumerate(sorted(ROWS, key=lambda r: (r[3], r[4]))):
        assert got[r[4]] == i


def test_first_in_order_and_lowest_by_key(spark, tiny_limits):
    want = [r[4] for r in sorted(ROWS, key=lambda r: (r[3], r[4]))]
    for n in (0, 1, 37, 200, 500):
        got = {r["row_key"] for r in skew.first_in_order(frame(spark, ROWS), n, ["ts", "row_key"]).collect()}
        assert got == set(want[:n])
    keyed = frame(spark, ROWS).withColumn("h", F.md5("row_key"))
    every = sorted((r["h"], r["row_key"]) for r in keyed.collect())
    got = {r["row_key"] for r in skew.lowest_by_key(keyed, 33, "h", "row_key").collect()}
    assert got == {k for _, k in every[:33]}


def test_matched_pairs_cover_every_pair_once(spark, tiny_limits):
    cells = sorted({(r[0], r[1]) for r in ROWS})
    df = spark.createDataFrame([(u, i, float(u * i)) for u, i in cells], "user_id bigint, item_id bigint, w double")
    got = matched_pairs(df, "user_id", "item_id").collect()
    by_user = defaultdict(list)
    for u, i in cells:
        by_user[u].append(i)
    want = Counter((u, a, b) for u, items in by_user.items() for a, b in combinations(sorted(items), 2))
    assert Counter((r["user_id"], r["a_item_id"], r["b_item_id"]) for r in got) == want
    assert all(r["a_w"] == r["user_id"] * r["a_item_id"] and r["b_w"] == r["user_id"] * r["b_item_id"] for r in got)


def test_matched_rows_cover_every_combination(spark, tiny_limits):
    left = frame(spark, ROWS).select("user_id", F.col("row_key").alias("l"))
    right = frame(spark, ROWS).select("user_id", F.col("row_key").alias("r"))
    got = Counter((r["l"], r["r"]) for r in matched_rows(left, right, "user_id", "l", "r").collect())
    assert got == Counter((a[4], b[4]) for a in ROWS for b in ROWS if a[0] == b[0])


def _no_search(*_):
    raise AssertionError("a search in an array of cuts for every row")


def test_positions_come_from_sorted_ranges(spark, tiny_limits, monkeypatch):
    """No row looks up its slice: that took most of the time of every query with a global position."""
    monkeypatch.setattr(skew, "_slice_of", _no_search)
    rows = [(None if i % 7 == 0 else i % 5, f"k{i * 37 % 101:03d}", i) for i in range(101)]
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(5, "c")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = {r["c"]: r["i"] for r in skew.dense_index(df, ["a", "b"], "i").collect()}
    assert [got[r[2]] for r in want] == list(range(101))
    packed = df.select(F.struct("a", "b").alias("s"), "c")
    assert {r["c"]: r["i"] for r in skew.dense_index(packed, ["s"], "i").collect()} == got
    for n in (0, 1, 3, 50, 101, 400):
        assert {r["c"] for r in skew.first_in_order(df, n, ["a", "b"]).collect()} == {r[2] for r in want[:n]}
    assert skew.dense_index(df.limit(0), ["a", "b"], "i").count() == 0


def test_first_rows_leave_most_rows_unsorted(spark, tiny_limits, monkeypatch):
    """Only rows up to a cut behind the n-th row go on; without enough of them all do."""
    seen = []
    whole = skew.dense_index
    monkeypatch.setattr(skew, "dense_index", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    df = spark.range(3000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    want = [r["k"] for r in sorted(df.collect(), key=lambda r: r["h"])][:9]
    assert {r["k"] for r in skew.first_in_order(df, 9, ["h"]).collect()} == set(want) and 9 <= seen[0] < 2500
    monkeypatch.setattr(skew, "_cuts", lambda rows, order: F.array(*[F.struct(F.lit("0").alias("h"))] * 16))
    assert {r["k"] for r in skew.first_in_order(df, 9, ["h"]).collect()} == set(want) and seen[1] == 3000


def test_lowest_by_key_with_a_large_bucket(spark, tiny_limits):
    df = spark.range(300).select(F.concat(F.lit("abcd"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("h"), "id")
    assert {r["id"] for r in skew.lowest_by_key(df, 40, "h", "id").collect()} == set(range(40))
