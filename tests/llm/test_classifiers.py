import zlib
from collections import Counter

import numpy as np
import pytest
from odd import empty, frame, texts

from ratingloom.llm import quality_cnn, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def held(pdf, labels, column, modulus, remainder):
    pdf = pdf[[zlib.crc32(str(i).encode()) % modulus == remainder for i in pdf["doc_id"]]]
    assert pdf["held_out"].all()
    return pdf.merge(labels.toPandas(), on="doc_id")[["doc_id", "score", "predicted", column]]


def test_quality_on_held_out_documents(spark, tables):
    rows = quality_cnn.op3_quality_classifier(spark, "/root/testdata/sf0.1").toPandas()
    assert len(rows) == tables[0].count() and rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all()
    rows = held(rows, tables[1], "quality", 4, 2)
    y = rows["quality"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.97
    assert rows["predicted"][y == 1].mean() > 0.97


def test_toxicity_on_held_out_documents(spark, tables):
    rows = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert len(rows) == tables[0].count() and rows["score"].between(0, 1).all()
    rows = held(rows, tables[1], "toxic", 3, 1)
    y = rows["toxic"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.9
    assert rows["predicted"][y == 0].mean() < 0.02


def test_odd_documents(spark):
    docs, labels = frame(spark), spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (15, 0, 0), (16, 0, 0), (23, 1, 1), (None, 1, 1), (3, None, None), (1, 1, 0)],
        "doc_id long, quality int, toxic int")
    net = quality_cnn.train(docs, labels)
    rated = quality_cnn.score_texts(docs, net)
    assert rated.columns == [*docs.columns, "_score"]
    assert Counter((r.doc_id, r.text) for r in rated.collect()) == Counter(texts())
    assert all(0 <= r._score <= 1 for r in rated.collect())
    rows = toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts()) and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = empty(spark)
    assert quality_cnn.score_texts(docs, quality_cnn.train(docs, labels)).count() == 0
    assert toxicity.score_texts(docs, toxicity.train(docs, labels)).count() == 0
    # without labels nothing is rejected and nothing called toxic
    docs = frame(spark)
    assert {r._score > 0.9 for r in quality_cnn.score_texts(docs, quality_cnn.train(docs, labels)).collect()} == {True}
    assert {r.score < 0.1 for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()} == {True}


def test_network_sees_every_byte():
    net = quality_cnn.ByteNetwork()
    data = np.random.default_rng(0).integers(97, 123, 5000, dtype=np.uint8)
    chunks, owner = net.chunks(data, np.array([0, 1700, 1700, 5000]))
    assert Counter(owner.tolist()) == {0: 4, 1: 1, 2: 7}
    windows = {bytes(w) for c in chunks[owner == 0] for w in np.lib.stride_tricks.sliding_window_view(c, net.width)}
    assert {bytes(data[i:i + net.width]) for i in range(1700 - net.width + 1)} <= windows


def test_network_gradients():
    rng = np.random.default_rng(4)
    net = quality_cnn.ByteNetwork(width=4, dims=3, filters=5)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    chunks, owner = rng.integers(0, 256, (5, quality_cnn.CHUNK)).astype(np.uint8), np.array([0, 0, 1, 2, 2])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        pooled, _, _ = net._pooled(net.responses(chunks).astype(np.float64), owner)
        p = 1 / (1 + np.exp(-(pooled @ net.weights["dense"] + net.weights["out"][0])))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + 5e-5 * (net.weights["dense"] ** 2).sum()
    grads = net._gradients(chunks, owner, labels)
    for name in ("conv", "dense", "out", "bias"):
        flat, grad = net.weights[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-3 - grad[i]) < 2e-3


def kernel(s: bytes, t: bytes) -> float:
    """The gapped triple kernel, summed naively."""
    def triples(x):
        out = Counter()
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, len(x)):
                    if k - i < toxicity.SPAN:
                        out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
        return out
    a, b = triples(s), triples(t)
    return sum(a[x] * b[x] for x in a) / toxicity._scale(len(s)) / toxicity._scale(len(t))


def test_machine_is_the_kernel_expansion():
    texts_ = [{b"idiot", b"some", b"words"}, {b"moron", b"other"}, {b"idiot", b"moron"}] * 8 + [
        {b"some", b"kind", b"words"}, {b"other", b"ideas"}, {b"more", b"things"}] * 16
    toxic = np.array([True] * 24 + [False] * 48)
    machine = toxicity.train_machine(texts_, toxic, np.ones(72))
    landmarks = toxicity.choose_landmarks(texts_, toxic)
    strings = [b"idiot", b"idxiot", b"moooron", b"things", b"words"]
    found = [machine.margins(np.frombuffer(b" " + s + b" ", np.uint8), np.array([1]), np.array([len(s) + 1]))[0] - machine.bias
             for s in strings]
    values = np.array([[kernel(b" " + s + b" ", t) for t in landmarks] for s in strings])
    weights, *_ = np.linalg.lstsq(values, np.array(found), rcond=None)
    assert np.allclose(values @ weights, found, atol=1e-3)
    assert min(found[:3]) > max(found[3:])


def test_units_drop_inserted_characters():
    raw = "An i.d-i*o_t, I D I O T x Éa\n b".encode()
    data, starts, ends, first = toxicity.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert all(data[a - 1] in b" \n" and data[b] in b" \n" for a, b in zip(starts, ends))
    assert [data.tobytes()[a:b].decode() for a, b in zip(starts, ends)] == ["an", "idiot", "idiotx", "éa", "b"]
