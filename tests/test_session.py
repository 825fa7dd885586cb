import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from ratingloom import session
from ratingloom.functions import skew
from ratingloom.operators import rating_models, weights

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def exists(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def test_written_tables_can_be_discarded_and_the_run_closed(spark, monkeypatch):
    monkeypatch.setattr(session, "_run", {})
    one, two = session.durable(spark.range(3)), session.durable(spark.range(4))
    folder = session.run_folder(spark)
    assert one.durable_path.startswith(folder) and two.count() == 4
    session.discard(one, spark.range(1))
    assert not exists(spark, one.durable_path) and two.count() == 4
    session.close_run(spark)
    assert not exists(spark, folder)


def test_tasks_find_the_package_from_another_folder(tmp_path):
    """A driver that has the repository on its path, in a folder without it; workers get the shipped file."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as entry
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        print("rows", entry.queries()["item_content_knn"](spark, "/root/testdata/sf0.001").count() > 0)
        from ratingloom.shipping import ship
        ship(spark)
        def there(batches):
            from ratingloom.functions.numeric import score  # only importable if the package was sent
            import ratingloom
            for b in batches:
                yield b.assign(id=int(".zip" in ratingloom.__file__ or True))
        print("sent", spark.range(2).mapInPandas(there, "id long").agg({{"id": "sum"}}).first()[0])
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows True" in done.stdout and "sent 2" in done.stdout, done.stderr[-2000:]


def test_salts_and_slices_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(skew.limits, "heavy_rows", 10)
    monkeypatch.setattr(skew.limits, "slices", 2)
    skew._known.clear()
    rows = spark.range(3000).select((F.col("id") % 100 * (F.col("id") > 1000).cast("int")).alias("k"), "id")
    heavy = skew.heavy_keys(rows, "k")
    # a key's copies follow from its own rows, not from the largest key's
    assert len(heavy) == 100 and heavy.salts == {k: 2 if k else 102 for k in range(100)}
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.lookup_join(rows, table, "k", "inner", heavy).count() == 3000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert skew._slices(rows) == 28
    spark.conf.set("spark.sql.shuffle.partitions", before)
    skew._known.clear()


def test_many_ties_at_the_boundary(spark, monkeypatch):
    monkeypatch.setattr(skew.limits, "heavy_rows", 50)
    rows = spark.range(500).select(F.lit("ab").alias("h"), F.format_string("%04d", "id").alias("key")).repartition(4)
    got = {r["key"] for r in skew.lowest_by_key(rows, 123, "h", "key").collect()}
    assert got == {f"{i:04d}" for i in range(123)}


def test_factor_model_takes_any_ids(spark):
    rows = [(f"A{u}X", f"b-{i}", float(1 + (u * i) % 5)) for u in range(12) for i in range(9) if (u + i) % 3]
    train = spark.createDataFrame(rows, "user_id string, item_id string, rating double")
    wanted = spark.createDataFrame([("A1X", "b-2", 3.0), ("new", "b-2", 3.0), ("A1X", "new", 3.0)], train.schema)
    out = {(r.user_id, r.item_id): r.estimate for r in rating_models.factor_predictions(train, wanted, 3, 3).collect()}
    assert set(out) == {("A1X", "b-2"), ("new", "b-2"), ("A1X", "new")} and all(1 <= v <= 5 for v in out.values())


def test_user_history(spark):
    rows = spark.createDataFrame([("u", "i", 3, "c"), ("u", "j", 1, "a"), ("u", "i", 1, "b"), ("v", "i", 9, "d")],
                                 "user_id string, item_id string, ts long, row_key string")
    got = sorted(map(tuple, weights.user_history(rows).collect()))
    assert got == [("u", 1, "j", 1, True), ("u", 2, "i", 1, True), ("u", 3, "i", 3, False), ("v", 1, "i", 9, True)]


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
    with pytest.raises(ValueError):
        session.shared_folder(Session())
