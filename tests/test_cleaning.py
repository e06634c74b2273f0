from __future__ import annotations

import pytest

from stacklore.operators import cleaning, explorer, stats, transactions, validate


def test_dedup_and_upsert(spark):
    rows = spark.createDataFrame([("n1", 1, 1), ("n2", 2, 2), ("n1", 3, 3), (None, 4, 4)], "k string, v int, at int")
    assert {(r["k"], r["v"]) for r in cleaning.dedup_first(rows, "k", "at").collect()} == {("n1", 1), ("n2", 2)}
    assert {(r["k"], r["v"]) for r in cleaning.dedup_last(rows, "k", "at").collect()} == {("n1", 3), ("n2", 2)}
    new = spark.createDataFrame([("n2", 9, 0), ("n5", 5, 0)], "k string, v int, at int")
    assert {(r["k"], r["v"]) for r in cleaning.upsert(rows, new, "k", "at").collect()} == {("n1", 3), ("n2", 9), ("n5", 5)}


def test_preprocess_takes_alternatives_and_missing_values(spark):
    raw = spark.createDataFrame(
        [
            (1, " a/b ", None, 0, 7, None, ["ML"], None, "2019-01-01", None, "kept"),
            (2, "a/b", None, 5, 5, "Go", None, "x", "2021", "mit", "dropped"),
            (3, None, "c/d", None, None, " Rust ", [None, "k8s"], "Text", None, "", None),
            (4, "", None, 1, 1, None, None, None, None, None, None),
        ],
        "row_no int, name string, full_name string, stars bigint, stargazers_count bigint, language string, topics array<string>, description string, created_at string, license string, extra string",
    )
    got = {r["name"]: r for r in cleaning.preprocess(raw, "row_no").collect()}
    assert set(got) == {"a/b", "c/d"}
    a, c = got["a/b"], got["c/d"]
    assert (a["stars"], a["language"], a["tech_stack"], a["created_year"], a["era"], a["license"], a["extra"]) == (7, "Unknown", ["machine-learning"], 2019, "2018-2021", "Unknown", "kept")
    assert a["combined_text"] == "machine-learning unknown"
    assert (c["stars"], c["language"], c["tech_stack"], c["html_url"]) == (0, "Rust", ["kubernetes", "rust"], "https://github.com/c/d")
    assert c["combined_text"] == "text kubernetes rust rust"
    assert cleaning.preprocess(raw.limit(0), "row_no").count() == 0


def test_export_cuts_and_sorts(spark):
    rows = spark.createDataFrame([("b", 1, ["t"] * 12, "d" * 300), ("a", 1, [], None)], "name string, stars bigint, topics array<string>, description string")
    out = cleaning.export_projection(rows).collect()
    assert [r["name"] for r in out] == ["a", "b"]
    assert (len(out[1]["topics"]), len(out[1]["description"]), out[0]["description"]) == (10, 260, "")


def test_flatten_record(spark):
    items = spark.read.json(spark.sparkContext.parallelize([
        '{"full_name":"a/b","stargazers_count":3,"forks_count":null,"watchers_count":1,"open_issues_count":0,"size":9,"language":null,"topics":["x"],"description":null,"homepage":null,'
        '"created_at":"2020-01-02T03:04:05Z","updated_at":null,"pushed_at":null,"license":{"spdx_id":"MIT"},"html_url":"u","default_branch":null,"archived":null,"owner":{"type":"User"}}'
    ]))
    r = cleaning.flatten_record(items).first()
    assert (r["name"], r["stars"], r["forks"], r["language"], r["created_at"], r["license"], r["default_branch"], r["archived"], r["owner_type"]) == ("a/b", 3, 0, "Unknown", "2020-01-02", "MIT", "main", False, "User")


def test_histograms(spark):
    rows = spark.createDataFrame([(0.0,), (0.05,), (0.99,), (1.0,), (None,), (1.7,)], "x double")
    assert [r["count"] for r in stats.confidence_histogram(rows, "x").orderBy("bucket").collect()] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 3]
    ones = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    out = stats.width_histogram(ones, "x", 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["count"]) for r in out] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]
    assert [r["count"] for r in stats.width_histogram(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]


def test_summary(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x bigint")
    r = stats.summary_stats(rows, ["x"]).first()
    assert (r["total"], r["mean"], r["median"], r["max"]) == (16, 4.0, 2.5, 10)
    assert stats.quantile(rows, "x", 0.99).first()[0] == pytest.approx(9.79)
    assert stats.summary_stats(rows.limit(0), ["x"]).first()["total"] is None


def test_explorer_pages(spark):
    rows = spark.createDataFrame([(f"n{i:03d}", i, "Go", "cat", "mid", ["x"], ["y"], "Some % text") for i in range(130)], "name string, stars int, language string, bert_category string, popularity string, topics array<string>, tech_stack array<string>, description string")
    assert explorer.explorer_page(rows, 3).count() == 10
    assert explorer.explorer_page(rows, 99).count() == 10
    assert explorer.explorer_page(rows, 0).first()["name"] == "n129"
    assert explorer.explorer_page(rows, query="% TEXT").count() == 60
    assert explorer.explorer_page(rows, query="nothing").count() == 0
    assert explorer.matching(rows, language="Rust").count() == 0
    assert sorted(r["stars"] for r in explorer.systematic_sample(rows, ["name"], 44).collect()) == list(range(0, 130, 3))


def test_recommendations_for_unknown_name_and_repeats(spark):
    sims = spark.createDataFrame([("a", 1, "b", 0.9), ("a", 1, "b", 0.9), ("a", 2, "z", None)], "name string, neighbour_no int, neighbour string, score double")
    repos = spark.createDataFrame([("b", "Go", "c", 1, "d", "u")], "name string, language string, bert_category string, stars bigint, description string, html_url string")
    got = explorer.recommendations(sims, repos, "a").orderBy("neighbour_no").collect()
    assert [(r["neighbour"], r["language"]) for r in got] == [("b", "Go"), ("z", None)]
    assert explorer.recommendations(sims, repos, "nobody").count() == 0


def test_basket_graph_limits(spark):
    rows = spark.createDataFrame([(1, 30, ["x", "y"]), (2, 20, ["x", "y"]), (3, 10, ["x"]), (4, 5, ["y"])], "id bigint, stars bigint, tech_stack array<string>")
    got = [tuple(r) for r in transactions.basket_similarity_graph(rows, "id", "tech_stack", "stars", top=3, per_item=2).collect()]
    assert got == [(1, 2, 2)]


def test_validation(spark):
    df = spark.createDataFrame([("a",)], "name string")
    assert validate.missing_columns(df, ("name", "stars")) == ["stars"]
    with pytest.raises(ValueError, match="stars"):
        validate.require_columns(df, ("stars",))
    assert validate.count_check({"t": df}, {"t": 1}).first()["ok"]
    assert validate.schema_check({"repos": df}).first()["missing"].startswith("stars")
