import zlib

import numpy as np
from pyspark.sql import functions as F

from ratingloom.llm import quality_cnn, repeats, toxicity


def seen(monkeypatch, docs, labels):
    """What the toxicity machine is trained on."""
    got = []
    monkeypatch.setattr(toxicity, "train_machine", lambda texts, toxic, weights: got.append((texts, toxic, weights)))
    toxicity.train(docs, labels)
    return got[0]


def test_class_weights_leave_out_held_out_labels_and_contradictions(spark, monkeypatch):
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = [i for i in range(60) if not out(i)]
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(60)], "doc_id long, text string")
    rows = [(i, int(n % 4 == 0)) for n, i in enumerate(known)]
    both = known[1]
    hidden = [(i, 1) for i in range(60) if out(i)]
    schema = "doc_id long, toxic int"
    plain = seen(monkeypatch, docs, spark.createDataFrame([r for r in rows if r[0] != both], schema))
    more = seen(monkeypatch, docs, spark.createDataFrame(rows + hidden + [(both, 1), rows[0]], schema))
    assert plain[0] == more[0] and not any(f"word{both}".encode() in t for t in more[0])
    assert np.array_equal(plain[1], more[1]) and np.allclose(plain[2], more[2])


def test_rows_that_repeat_an_id_count_once(spark, monkeypatch):
    rows = [(i, f"word{i} text") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    hot = plain.unionByName(spark.createDataFrame(rows[:12] * 50, "doc_id long, text string"))
    once, often = seen(monkeypatch, plain, labels), seen(monkeypatch, hot, labels)
    assert once[0] == often[0] and np.allclose(once[2], often[2])
    sizes = []
    monkeypatch.setattr(quality_cnn.ByteNetwork, "fit", lambda self, chunks, owner, y: sizes.append(len(y)))
    quality_cnn.train(plain, labels)
    quality_cnn.train(hot, labels)
    assert sizes[0] == sizes[1]


def test_equal_rows_share_a_short_list_of_spans(spark):
    docs = spark.createDataFrame([(1, "some text")] * 40 + [(None, "other")] * 20, "doc_id long, text string")
    spans = docs.select("doc_id", repeats.text_hash(F.col("text")).alias("th"), F.lit(0).cast("long").alias("start"),
                        F.lit(5).cast("long").alias("size"))
    got = repeats.with_spans(docs, spans).collect()
    assert len(got) == 60 and all(len(r.spans) == 1 for r in got)
