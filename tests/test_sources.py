from __future__ import annotations

import base64
import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from stacklore.plans import pipeline
from stacklore.sources import files, paged
from stacklore.streaming import collect


def test_json_array_round_trip(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "b", "stars": 1, "topics": ["é"]}, {"name": "a"}]), encoding="utf-8")
    rows = files.read_json_array(spark, str(tmp_path / "r.json"))
    assert [(r["row_no"], r["name"], r["stars"]) for r in rows.orderBy("row_no").collect()] == [(0, "b", 1), (1, "a", None)]
    files.write_json_array(rows.orderBy("row_no").select("name", "topics"), str(tmp_path / "o.json"), 2)
    assert json.loads((tmp_path / "o.json").read_text(encoding="utf-8")) == [{"name": "b", "topics": ["é"]}, {"name": "a", "topics": None}]
    assert "é" in (tmp_path / "o.json").read_text(encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"name": "x"}')
    with pytest.raises(Exception, match="JSON list"):
        files.read_json_array(spark, str(tmp_path / "bad.json")).collect()


def test_json_lines_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x"]), (None, None)], "name string, topics array<string>")
    files.write_json_lines(rows, str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "name string, topics array<string>").count() == 2
    files.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["name", "topics"]


def test_decode_readme(spark):
    good = base64.encodebytes("Größe ".encode() * 20 + b"\xff!").decode()
    rows = spark.createDataFrame([(1, good), (2, "!!!"), (3, None), (4, "")], "id int, c string")
    got = {r["id"]: r["t"] for r in rows.select("id", files.decode_readme(F.col("c")).alias("t")).collect()}
    assert got == {1: "Größe " * 20 + "!", 2: "", 3: "", 4: ""}


def test_query_plan():
    plan = paged.query_plan()
    assert len(plan) == len(set(plan)) == 173
    assert plan[:2] == ["topic:machine-learning stars:100..499", "topic:machine-learning stars:500..999"]
    assert [paged.pages(n) for n in (1, 100, 101, 9999)] == [1, 1, 2, 10]


def test_requests_wait_for_the_rate_limit():
    replies = [(403, {"X-RateLimit-Reset": "100", "X-RateLimit-Remaining": "0"}), (429, {}), (403, {"X-RateLimit-Reset": "100", "X-RateLimit-Remaining": "7"}), (200, None)]
    slept = []

    def opener(request, timeout):
        code, headers = replies.pop(0)
        if code != 200:
            raise urllib.error.HTTPError(request.full_url, code, "", headers, None)
        return io.BytesIO(b'{"items": [1]}')

    assert paged.request_json("http://a.example", sleep=slept.append, clock=lambda: 90, opener=opener) == {"items": [1]}
    assert slept == [13, 60, 60]

    def fails(code):
        def opener(request, timeout):
            raise urllib.error.HTTPError(request.full_url, code, "", {}, None)

        return opener

    assert paged.request_json("http://a.example", opener=fails(422)) == {}
    with pytest.raises(urllib.error.HTTPError):
        paged.request_json("http://a.example", opener=fails(500))


def test_paged_source(spark, tmp_path):
    for shard, page, items in ((0, 1, [{"full_name": "a/b", "license": {"spdx_id": "MIT", "x": 1}, "owner": None}]), (0, 2, []), (0, 3, [{"full_name": "unseen"}]), (1, 1, [{"full_name": "c/d"}])):
        (tmp_path / str(shard)).mkdir(exist_ok=True)
        (tmp_path / str(shard) / f"{page}.json").write_text(json.dumps({"items": items}))
    spark.dataSource.register(paged.PagedSearch)
    rows = spark.read.format("paged_search").option("url", f"file://{tmp_path}").option("queries", json.dumps(["q", "r"])).option("perQuery", "500").load()
    assert {(r["full_name"], r["license"]["spdx_id"]) for r in rows.collect()} == {("a/b", "MIT"), ("c/d", None)}
    assert rows.rdd.getNumPartitions() == 2


def test_collect_until_the_target(spark, tmp_path):
    for shard, names in enumerate((["a/b", "c/d"], ["a/b", "e/f"], ["unseen"])):
        (tmp_path / str(shard)).mkdir()
        (tmp_path / str(shard) / "1.json").write_text(json.dumps({"items": [{"full_name": n, "stargazers_count": shard} for n in names]}))
    # shards are numbered anew in each request, so all are asked at once here
    table = paged.collect(spark, f"file://{tmp_path}", ["q", "r"], target=3, at_once=2)
    assert {(r["name"], r["stars"]) for r in table.collect()} == {("a/b", 1), ("c/d", 0), ("e/f", 1)}
    again = paged.collect(spark, f"file://{tmp_path}", ["q", "r", "s"], target=3, existing=table)
    assert again.count() == 3

    def fetch(name):
        if name == "c/d":
            raise OSError
        return f"readme of {name}"

    got = {r["name"]: r["readme"] for r in paged.with_readmes(table, fetch, 3).collect()}
    assert got == {"a/b": "readme of a/b", "c/d": "", "e/f": "readme of e/f"}


def test_retries_and_languages(spark):
    codes = [500, 429, 200]
    slept = []

    def opener(request, timeout):
        if (code := codes.pop(0)) != 200:
            raise urllib.error.HTTPError(request.full_url, code, "", {}, None)
        return io.BytesIO(b"{}")

    assert paged.request_with_retries("http://a.example", sleep=slept.append, opener=opener) == {}
    assert slept == [3, 10]
    codes[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        paged.request_with_retries("http://a.example", opener=opener)
    df = spark.createDataFrame([({"Go": 5, "C": 9, "Ada": 5},)], "m map<string, bigint>")
    assert df.select(paged.languages_by_bytes(F.col("m"))).first()[0] == ["C", "Ada", "Go"]


def test_streamed_collection(spark, tmp_path):
    kind = "name string, row_id bigint, stars bigint"
    for rows in ([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], [("b", 4, 9), ("c", 5, 5)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        collect.collect_into(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["name"], r["stars"]) for r in collect.current(spark, str(tmp_path / "out")).collect()} == {("a", 3), ("b", 9), ("c", 5)}
    assert collect.current(spark, str(tmp_path / "nothing")) is None


def test_whole_pipeline(spark, tmp_path):
    tags = [["k8s", "docker"], ["docker", "helm"], ["react", "css"], ["css", "vue"]]
    raw = [{"name": f"o/r{i}", "stars": i * 100, "language": "Go" if i % 4 < 2 else "TypeScript", "topics": tags[i % 4], "description": f"A {' '.join(tags[i % 4])} project number{i % 7} for teams", "created_at": f"20{15 + i % 9}-01-01"} for i in range(40)]
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    done = pipeline.run(spark, files.read_json_array(spark, str(tmp_path / "raw.json")), str(tmp_path / "out"), clusters=3, svd_dims=8)
    assert (done["total_repos"], done["stars"]["max"]) == (40, 3900)
    repos = json.loads((tmp_path / "out/repos.json").read_text())
    assert len(repos) == 40 and repos[0]["name"] == "o/r39"
    assert {"bert_category", "cluster_id", "pca_x"} <= set(repos[0])
    near = json.loads((tmp_path / "out/similarities.json").read_text())
    assert len(near) == 40 and all(len(n["neighbours"]) == 8 for n in near)
    assert json.loads((tmp_path / "out/association_rules.json").read_text())
    assert "Association rules" in (tmp_path / "out/project_report.md").read_text()
    with pytest.raises(ValueError, match="weights"):
        pipeline.embed(spark.createDataFrame([(1, "x")], "id bigint, text string"), "bert")


def test_pipeline_takes_whole_texts(spark, tmp_path, monkeypatch):
    raw = [{"name": f"o/r{i}", "stars": i, "language": "Go", "topics": ["docker", "helm"], "description": "short", "readme": "filler " * 400 + "farend", "created_at": "2020-01-01"} for i in range(6)]
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    seen = []

    def embed(docs, **options):
        seen.append([r["text"] for r in docs.collect()])
        raise InterruptedError

    monkeypatch.setattr(pipeline, "embed", embed)
    for limits in ({}, {"readme_limit": 1800}):
        with pytest.raises(InterruptedError):
            pipeline.run(spark, files.read_json_array(spark, str(tmp_path / "raw.json")), str(tmp_path / "out"), **limits)
    assert all("farend" in t for t in seen[0]) and len(seen[0]) == 6
    assert not any("farend" in t for t in seen[1])
