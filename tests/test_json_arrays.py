import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from ratingloom.sources import reviews
from ratingloom.sources.json_arrays import array_elements

ODD = ['a"b', "\\", '\\"', "{", "}]", "[,", "\\\\", "é漢😀", "", "x" * 300, "tab\t\n", '"{"a":1}"']


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))
    if kind < 4:
        return rng.choice([1, 2.5, True, None])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(ODD) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "2500")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def elements(spark, path, chunk_bytes):
    rows = array_elements(spark, str(path), chunk_bytes).orderBy("seq").collect()
    return [None if r["value"] is None else json.loads(r["value"], strict=False) for r in rows]


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 1), (3, None)])
def test_elements_over_many_splits(spark, tmp_path, small_splits, seed, indent):
    rng = random.Random(seed)
    wanted = [value(rng) for _ in range(150)] + [{"n": i, "t": rng.choice(ODD)} for i in range(60)]
    rng.shuffle(wanted)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(wanted, indent=indent, ensure_ascii=seed == 3), encoding="utf-8")
    splits = spark.read.option("lineSep", "{").text(str(path)).select("_metadata.file_block_start").distinct().count()
    assert splits > 3
    for chunk_bytes in (1, 200, 1 << 20):
        assert elements(spark, path, chunk_bytes) == wanted


def test_several_files_gzip_and_other_roots(spark, tmp_path, small_splits):
    many = [{"i": i, "t": "}{" * (i % 5)} for i in range(100)]
    (tmp_path / "a.json").write_text(json.dumps(many))
    gzip.open(tmp_path / "b.json.gz", "wt").write(json.dumps(many, indent=2) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"one": many[:40]}, indent=1))
    (tmp_path / "d.json").write_text(" [ ] \n")
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.json").write_text('[{"a": 1}, {"b": 2}] trailing {"c": [3]}, [4]')
    (tmp_path / "g.json").write_text('{"x":1}')
    assert elements(spark, tmp_path, 100) == [*many, *many, {"one": many[:40]}, {"a": 1}, {"b": 2}, {"x": 1}]


def test_damaged_file_keeps_what_stands_before(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[{"user_id": "u1", "rating": 2}, {"user_id": "u2", "rating": 3}, {"user_id": "u3", "ra')
    for chunk_bytes in (1, 1000):
        rows = reviews.parse_interactions(array_elements(spark, str(path), chunk_bytes)).collect()
        assert sorted(r["user_id"] for r in rows) == ["u1", "u2"]


def test_long_elements_and_rows_in_order(spark, tmp_path, small_splits):
    wanted = [{"user_id": f"u{i}", "item_id": "i", "rating": 1.0, "timestamp": i, "text": "word, [ " * (900 if i % 7 == 0 else 3)}
              for i in range(30)]
    path = tmp_path / "x.json"
    path.write_text(json.dumps(wanted))
    rows = reviews.read_interactions(spark, str(path), "array").orderBy("seq").select("user_id", F.col("raw_data")["text"].alias("t")).collect()
    assert [(r["user_id"], r["t"]) for r in rows] == [(w["user_id"], w["text"]) for w in wanted]
