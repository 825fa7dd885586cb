import gzip
import json

import pytest
from pyspark.sql import functions as F

from ratingloom.sources import movielens, reviews

RECORDS = [
    {"reviewerID": "u1", "asin": "i1", "overall": 4.0, "unixReviewTime": 100, "helpful": [1, 2], "verified": True, "reviewText": "fine"},
    {"reviewerID": "u2", "overall": 3.0},
    {"user_id": "u3", "item_id": "i3", "rating": "2.5", "timestamp": 7},
    {"reviewerID": None, "asin": "i1", "overall": 1.0},
]


def write(path, lines, zipped=False):
    (gzip.open if zipped else open)(path, "wt").write("\n".join(lines) + "\n")
    return str(path)


def test_gzip_lines_skip_malformed(spark, tmp_path):
    path = write(tmp_path / "r.json.gz", [json.dumps(r) for r in RECORDS] + ["", "{broken", "[1, 2]"], True)
    rows = sorted(map(str, reviews.load_reviews(spark, path).select("user_id", "item_id", "rating", "ts", "category").collect()))
    assert len(rows) == 4
    got = {r["user_id"]: r for r in reviews.load_reviews(spark, path).collect()}
    assert (got["u2"]["item_id"], got["u2"]["ts"]) == ("unknown", 0)
    assert got[None]["item_id"] == "i1" and got["unknown"]["rating"] == 1.0


def test_null_rating_fails_or_drops(spark, tmp_path):
    path = write(tmp_path / "r.json", ['{"reviewerID":"a","asin":"b","overall":null}', '{"reviewerID":"a","asin":"c"}'])
    assert reviews.load_reviews(spark, path, "drop").count() == 1
    with pytest.raises(Exception, match="unusable rating"):
        reviews.load_reviews(spark, path, "fail").collect()


def test_missing_path_raises(spark):
    with pytest.raises(Exception):
        reviews.load_reviews(spark, "/nowhere/at/all.json").count()


@pytest.mark.parametrize("layout", ["lines", "array"])
def test_read_interactions_layouts(spark, tmp_path, layout):
    path = tmp_path / "x.json"
    if layout == "lines":
        write(path, [json.dumps(r) for r in RECORDS])
    else:
        path.write_text(json.dumps(RECORDS, indent=1))
    assert reviews.detect_layout(spark, str(path)) == layout
    got = {(r["user_id"], r["item_id"]): r["rating"] for r in reviews.read_interactions(spark, str(path)).collect()}
    assert got[("u3", "i3")] == 2.5 and got[("u2", "unknown")] == 3.0
    half = reviews.read_interactions(spark, str(path), transform=lambda df: df.withColumn("rating", F.col("rating") / 2))
    assert half.filter("user_id = 'u3'").first()["rating"] == 1.25


def test_single_object_file(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(RECORDS[0], indent=2))
    assert reviews.read_interactions(spark, str(path)).count() == 1


def test_wide_rows_and_first_users(spark, tmp_path):
    lines = [json.dumps({"reviewerID": u, "asin": f"i{n}", "overall": 5.0}) for n, u in enumerate(["a", "b", "a", "c", "b"])]
    rows = reviews.parse_wide(reviews.read_lines(spark, write(tmp_path / "w.json", lines)), 2).collect()
    assert sorted(r["item_id"] for r in rows) == ["i0", "i1", "i2", "i4"]
    assert rows[0]["helpful"] == [0, 0] and rows[0]["verified"] is False


def test_split_keeps_lines_and_order(spark, tmp_path):
    lines = [f"line {i}" if i % 4 else "" for i in range(50)]
    numbered = reviews.number_parts(reviews.read_lines(spark, write(tmp_path / "s.json", lines)), ["seq"], 10)
    reviews.write_parts(numbered, str(tmp_path / "parts"))
    kept = [x for x in lines if x]
    for part in range(4):
        files = sorted((tmp_path / "parts" / f"part={part}").glob("*.txt"))
        assert len(files) == 1 and files[0].read_text().split("\n")[:-1] == kept[part * 10:part * 10 + 10]


def test_movielens_layout(spark, tmp_path):
    ratings = write(tmp_path / "u.test", ["1\t6\t5\t887431973", "2\t7\t3\t887431974"])
    users = write(tmp_path / "u.user", ["1|24|M|technician|85711"])
    genres = write(tmp_path / "u.genre", ["unknown|0", "Action|1", ""])
    assert movielens.load_ratings(spark, ratings).filter("rating = 5").first()["item_id"] == 6
    assert movielens.load_users(spark, users).first()["zip"] == "85711"
    assert movielens.load_genres(spark, genres).count() == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_lines_are_built_once(spark):
    """The text of the lines is not made again by every pass over them."""
    from ratingloom.registry import files
    assert "to_json" not in _plan(files._lines(spark, "/root/testdata/sf0.001"))


def test_sampled_users_need_one_parse(spark):
    """Choosing users reads their rows several times, but parses the lines once."""
    rows = [(f'{{"reviewerID":"u{i % 4}","asin":"i{i}","overall":{i % 5}}}', i) for i in range(20)]
    out = reviews.parse_wide(spark.createDataFrame([*rows, ("{broken", 20)], "value string, seq long"), 2)
    assert "json_object_keys" not in _plan(out)
    assert sorted((r.user_id, r.item_id, r.rating, r.seq) for r in out.collect()) == sorted(
        (f"u{i % 4}", f"i{i}", float(i % 5), i) for i in range(20) if i % 4 < 2)


def test_tokens_are_made_once(spark):
    """The lemma table and the join read written tokens, not the texts."""
    from ratingloom.registry import texts
    found = texts._lemmas(spark, "/root/testdata/sf0.001").inputFiles()
    assert found and not any("documents.parquet" in f for f in found)
