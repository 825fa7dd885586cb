import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from ratingloom.llm import decontaminate, packing, quality_cnn
from ratingloom.session import durable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(durable(stage(spark, out[-1], SF)))
    return [s.toPandas() for s in out]


def test_stages_keep_the_columns(steps):
    assert [list(s.columns) == list(steps[0].columns) for s in steps] == [True] * 5 + [False]
    assert len(steps[0]) > len(steps[1]) > len(steps[2]) > len(steps[3]) == len(steps[4])


def test_quality_stage(spark, steps):
    net = quality_cnn.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    raw = [(i, (t or "").encode()) for i, t in zip(steps[0]["doc_id"], steps[0]["text"])]
    keep = {i for i, t in raw if net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] >= cp.REJECT_BELOW}
    assert set(steps[1]["doc_id"]) == keep
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels["quality"] == 1]["doc_id"])
    assert len(good & keep) >= 0.97 * len(good)


def test_near_duplicate_stage(steps):
    from test_near_dedup import brute
    rows = [(int(i), t) for i, t in zip(steps[1]["doc_id"], steps[1]["text"])]
    assert set(steps[2]["doc_id"]) == {i for i, _, _, kept in brute(rows, 5, 80, 100) if kept}


def test_leak_stage(spark, steps):
    from test_decontamination import brute
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = list(zip(steps[2]["doc_id"], steps[2]["text"]))
    assert set(steps[3]["doc_id"]) == set(steps[2]["doc_id"]) - {e[0] for e in brute(rows, items)}
    assert decontaminate.build_index(items) is not None


def test_secret_stage(steps):
    from test_native import base
    before, after = (dict(zip(s["doc_id"], s["text"])) for s in steps[3:5])
    assert set(before) == set(after)
    assert not any(base(t) for t in after.values())
    assert sum(before[i] == after[i] for i in before) > 0.8 * len(before)


def test_secret_stage_changes_texts(spark):
    docs = spark.createDataFrame([(1, "x password: abcdef1", 19, "a", "b"), (2, None, 0, "a", "b"), (3, "clean", 5, None, None)],
                                 "doc_id long, text string, n_chars int, lang string, source string")
    found = {tuple(r)[:3] for r in cp.secrets(spark, docs, SF).collect()}
    assert found == {(1, "x [secret]", 10), (2, None, 0), (3, "clean", 5)}


def test_chars_of_the_secret_stage(steps):
    assert all(n == len(t) for n, t in zip(steps[4]["n_chars"], steps[4]["text"]))


def test_packing_stage(steps):
    from ratingloom.llm.tokens import encoder
    tokenizer = encoder(packing.tokenizer_path(packing.VOCABULARY)).tokenizer
    expect = Counter()
    for i, t in zip(steps[4]["doc_id"], steps[4]["text"]):
        expect[i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())] += 1
    short = steps[5][steps[5].groupby("doc_id")["piece"].transform("max") == 0]
    assert set(zip(short["doc_id"], short["ids_crc32"])) <= set(expect)
    assert set(steps[5]["doc_id"]) == set(steps[4]["doc_id"])
    assert steps[5].groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
