from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklore.operators import bert, semantic


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(rows)], "id bigint, vector array<double>")


@pytest.mark.parametrize(("best", "second", "confidence"), [(0.9, 0.4, 0.775), (0.5, 0.5, 0.55), (1.8, 0.2, 1.0)])
def test_confidence(spark, best, second, confidence):
    scores = spark.createDataFrame([(1, 0, "a", second), (1, 1, "b", best)], "id bigint, position int, category string, score double")
    r = semantic.classify(scores).first()
    assert r["bert_confidence"] == confidence
    assert r["bert_category"] == ("a" if best == second else "b")


def test_knn_equals_brute_force_with_ties_zero_and_null(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(60, 5))
    x[7] = x[3]
    x[9] = 0
    rows = [*x.tolist(), None]
    got = {}
    for r in semantic.knn_cosine(vectors(spark, rows), 4).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"], r["score"]))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in range(60):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((np.arange(60), -np.round(s, 9))) if j != i][:4]
        assert [g[1] for g in sorted(got[i])] == order
        assert [g[2] for g in sorted(got[i])] == pytest.approx([max(0, s[j]) for j in order], abs=1e-5)
    assert semantic.knn_cosine(vectors(spark, [])).count() == 0


def test_knn_of_few_rows(spark):
    assert semantic.knn_cosine(vectors(spark, [[1, 0]]), 8).count() == 0
    assert semantic.knn_cosine(vectors(spark, [[1, 0], [0, 1]]), 8).count() == 2


def test_tfidf_has_length_one(spark):
    docs = spark.createDataFrame([(1, "red green red"), (2, "green blue blue"), (3, None), (4, "")], "id bigint, text string")
    got = semantic.tfidf_weights(docs, stop_words=[])
    assert {(r["id"], r["term"]) for r in got.collect()} == {(1, "green"), (2, "green")}
    got = semantic.tfidf_weights(docs, min_df=1, stop_words=["red"])
    for r in got.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("l")).collect():
        assert r["l"] == pytest.approx(1)


def test_svd_keeps_products(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab cd", "ab cd ef", "ef gh", "gh ij ab", "ij kl"])], "id bigint, text string")
    weights = semantic.tfidf_weights(docs, min_df=1, grams=1, stop_words=[])
    got = {r["id"]: np.array(r["vector"]) for r in semantic.svd_embed(weights, 96).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in got.values())
    assert got[0] @ got[1] > got[0] @ got[4]


def test_clusters_and_projection(spark):
    rows = [[0, 0.0], [0, 0.1], [9, 9.0], [9, 9.1]]
    labels = {r["id"]: r["cluster_id"] for r in semantic.kmeans_clusters(vectors(spark, rows), 2).collect()}
    assert labels[0] == labels[1] != labels[2] == labels[3]
    assert {r["cluster_id"] for r in semantic.kmeans_clusters(vectors(spark, rows), 1).collect()} == {0}
    got = {r["id"]: r["pca_x"] for r in semantic.pca_projection(vectors(spark, [[0, 0], [2, 0], [4, 0]])).collect()}
    assert sorted(abs(v) for v in got.values()) == [0, 2, 2]
    one = {r["id"]: (r["pca_x"], r["pca_y"]) for r in semantic.pca_projection(vectors(spark, [[0], [2]])).collect()}
    assert one == {0: (-1.0, 0.0), 1: (1.0, 0.0)}


def test_label_evaluation(spark):
    raw = spark.createDataFrame([(1, "cv"), (2, "nlp"), (3, "odd"), (4, None)], "id bigint, code string")
    expected = semantic.expected_categories(raw)
    assert {(r["id"], r["category"]) for r in expected.collect()} == {(1, "Computer Vision"), (2, "Natural Language Processing")}
    predicted = spark.createDataFrame([(1, "Computer Vision"), (2, "Security"), (9, "x")], "id bigint, category string")
    assert tuple(semantic.label_accuracy(predicted, expected).first()) == (0.5, 2)
    assert {tuple(r) for r in semantic.confusion_matrix(predicted, expected).collect()} == {("Computer Vision", "Computer Vision", 1), ("Natural Language Processing", "Security", 1)}


def test_word_pieces():
    pieces = bert.WordPieces(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##s", ",", "cafe"])
    assert pieces.words("Café, PLAYING!") == ["cafe", ",", "playing", "!"]
    ids, mask = pieces.encode(["Café, PLAYING!", None], 16)
    assert ids.tolist() == [[2, 8, 7, 4, 5, 1, 3], [2, 3, 0, 0, 0, 0, 0]]
    assert mask.sum(1).tolist() == [7, 2]
    assert pieces.encode(["play " * 99], 16)[0].shape == (1, 16)


def tensors():
    random = np.random.default_rng(0)
    t, d = {}, 8
    shapes = {"embeddings.word_embeddings": (9, d), "embeddings.position_embeddings": (16, d), "embeddings.token_type_embeddings": (2, d)}
    for name, shape in shapes.items():
        t[f"{name}.weight"] = random.normal(size=shape).astype(np.float32)
    norms = ["embeddings.LayerNorm", *[f"encoder.layer.{i}.{p}.LayerNorm" for i in range(2) for p in ("attention.output", "output")]]
    for name in norms:
        t[f"{name}.weight"], t[f"{name}.bias"] = np.ones(d, np.float32), np.zeros(d, np.float32)
    for i in range(2):
        for p, (o, n) in {"attention.self.query": (d, d), "attention.self.key": (d, d), "attention.self.value": (d, d), "attention.output.dense": (d, d), "intermediate.dense": (12, d), "output.dense": (d, 12)}.items():
            t[f"encoder.layer.{i}.{p}.weight"] = random.normal(size=(o, n)).astype(np.float32)
            t[f"encoder.layer.{i}.{p}.bias"] = random.normal(size=o).astype(np.float32)
    return t


def test_encoder_and_tensor_file(spark, tmp_path):
    t = tensors()
    head, body = {"__metadata__": {}}, b""
    for name, x in t.items():
        head[f"bert.{name}"] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes]}
        body += x.tobytes()
    head["half"] = {"dtype": "BF16", "shape": [1], "data_offsets": [len(body), len(body) + 2]}
    body += b"\x80\x3f"
    text = json.dumps(head).encode()
    (tmp_path / "m").write_bytes(struct.pack("<Q", len(text)) + text + body)
    read = bert.read_safetensors((tmp_path / "m").read_bytes())
    assert read.pop("half").tolist() == [1.0]
    assert all((read[k] == t[k]).all() for k in t)
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##s", ",", "cafe"]
    (tmp_path / "v").write_text("\n".join(words))
    model = bert.Encoder(t, bert.WordPieces(words))
    assert np.allclose(model.encode(["play"]), model.encode(["play", "cafe plays, playing"])[:1], atol=1e-5)  # padding has no effect
    docs = spark.createDataFrame([(1, "play"), (2, None)], "id bigint, text string")
    got = {r["id"]: r["vector"] for r in bert.bert_embed(docs, str(tmp_path / "m"), str(tmp_path / "v")).collect()}
    assert got[1] == pytest.approx(model.encode(["play"])[0].tolist(), abs=1e-5)
    assert np.linalg.norm(got[2]) == pytest.approx(1, abs=1e-5)


def test_every_document_gets_a_vector_and_every_term_a_weight(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab cd", "ab cd ef", "ef gh ab", "alone", None])], "id bigint, text string")
    got = {r["id"]: r["vector"] for r in semantic.svd_embed(semantic.tfidf_weights(docs, grams=1, stop_words=[]), docs=docs).collect()}
    assert set(got) == set(range(5)) and len({len(v) for v in got.values()}) == 1
    assert not any(got[3] + got[4]) and np.linalg.norm(got[0]) == pytest.approx(1)
    assert semantic.svd_embed(semantic.tfidf_weights(docs.filter("id > 2")), docs=docs.filter("id > 2")).count() == 2
    many = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(13_000))) for i in range(2)], "id bigint, text string")
    assert semantic.tfidf_weights(many, grams=1, stop_words=[]).count() == 26_000


def test_svd_without_a_dense_table_in_the_driver(spark, monkeypatch):
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix

    monkeypatch.setattr(IndexedRowMatrix, "computeSVD", None)
    random = np.random.default_rng(7)
    a = random.random((300, 260)) * (random.random((300, 260)) < 0.05) * np.arange(1, 261) ** -0.3
    weights = spark.createDataFrame([(int(i), f"t{j:03}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "id bigint, term string, weight double")
    got = {r["id"]: np.array(r["vector"]) for r in semantic.svd_embed(weights, 8).collect()}
    v = np.linalg.svd(a)[2][:8].T
    for i, x in got.items():
        want = a[i] @ v / np.linalg.norm(a[i] @ v)
        assert x @ got[0] == pytest.approx(want @ (a[0] @ v) / np.linalg.norm(a[0] @ v), abs=1e-6)
    assert len(got) == (a.any(axis=1)).sum()
    symmetric = a.T @ a
    basis = np.zeros((40, 260))  # restarts
    s, m = semantic._directions(lambda x: symmetric @ x, 260, 8, basis, 4)
    found = basis[:m].T @ s
    assert np.abs(found @ (found.T @ v) - v).max() < 1e-5
