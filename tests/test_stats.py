from __future__ import annotations

import numpy as np
import pytest

from stacklore.operators import stats, validate


def test_quantiles_equal_numpy(spark):
    random = np.random.default_rng(1)
    a = [*random.integers(0, 9, 300).tolist(), None, None]
    b = [*random.normal(size=301).tolist(), None]
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a bigint, b double").selectExpr("*", "CAST(NULL AS double) AS none")
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {(r["field"], r["share"]): r["value"] for r in stats.exact_quantiles(df, ["a", "b", "none"], shares).collect()}
    for name, x in (("a", a), ("b", b)):
        for s in shares:
            assert got[name, s] == pytest.approx(np.quantile([v for v in x if v is not None], s))
    assert len(got) == 2 * len(shares)
    assert stats.quantile(df, "none", 0.5).first()["quantile"] is None
    assert stats.describe_exact(df.limit(0), ["a"]).first()["q50"] is None
    assert stats.summary_stats(df, ["a"]).first()["median"] == np.median([v for v in a if v is not None])


def test_no_quantile_is_held_in_one_buffer(spark):
    plan = stats.describe_exact(spark.range(10).selectExpr("id AS a"), ["a"])._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan


def test_trends_of_many_items(spark):
    df = spark.range(3000).selectExpr("array(concat('i', id), 'all') AS items", "2020 AS year")
    top = spark.range(3000).selectExpr("concat('i', id) AS item")
    assert stats.trend_counts(df, "items", "year", top).count() == 3000


def test_validation_checks(spark):
    repos = spark.range(30).selectExpr(
        "concat('r', id) AS name", "id AS stars", "id AS forks", "'x' AS language", "array('t') AS topics", "'d' AS description", "array('t') AS tech_stack", "concat('c', id % 6) AS bert_category",
        "0.5 AS bert_confidence", "1 AS cluster_id", "0.1 AS pca_x", "0.1 AS pca_y", "'u' AS html_url", "'github_api' AS data_origin",
    )
    nodes = spark.range(20).selectExpr("id", "0.1 AS pagerank", "0.1 AS hub", "0.1 AS authority", "1 AS community")
    rules = spark.range(100).selectExpr(*[f"0.1 AS {c}" for c in validate.MEASURES])
    known = {"total_repos": 30, "total_categories": 6, "embedding_method": "tfidf"}
    got = validate.validation_checks(repos, repos, nodes, spark.range(100), rules, repos.select("name"), known, True, True).collect()
    assert [(r["score"], r["max_score"]) for r in got] == [(2, 2)] * 4 + [(1, 1)] * 2 + [(5, 5)]
    bare = repos.selectExpr("* EXCEPT (tech_stack)", "CASE WHEN stars = 3 THEN array() ELSE tech_stack END AS tech_stack")
    got = validate.validation_checks(repos.limit(3), bare, nodes.drop("hub"), spark.range(99), rules.limit(99), repos.select("name").limit(4), {}, False, False)
    assert [r["status"] for r in got.collect()] == ["FAIL"] * 7
