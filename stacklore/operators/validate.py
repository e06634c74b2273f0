"""Checks of the produced tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = {
    "repos": ("name", "stars", "forks", "language", "tech_stack", "bert_category", "bert_confidence"),
    "nodes": ("id", "pagerank", "hub", "authority", "community"),
    "rules": ("antecedent", "consequent", "support", "confidence", "lift", "conviction", "leverage"),
}


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns that the table lacks, in their order."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required) -> DataFrame:
    """The table itself; an error that names what is missing."""
    if gone := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def schema_check(tables: dict[str, DataFrame], required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(table, missing) for each table; missing is '' where all is there."""
    spark = next(iter(tables.values())).sparkSession
    required = required or REQUIRED
    rows = [(name, ", ".join(missing_columns(df, required.get(name, ())))) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table string, missing string")


def count_check(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(table, rows, expected, ok): whether tables have the numbers of rows recorded for them."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, df.count(), expected.get(name)) for name, df in tables.items()]
    return spark.createDataFrame([(n, c, e, c == e) for n, c, e in rows], "table string, rows bigint, expected bigint, ok boolean")


def scored(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """(item, status, score, max_score) of boolean aggregates of one table, in one pass."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, (c, _) in enumerate(checks.values())])
    rows = [F.struct(F.lit(n).alias("item"), F.col(f"c{i}").alias("ok"), F.lit(m).alias("max_score")) for i, (n, (_, m)) in enumerate(checks.items())]
    out = one.select(F.inline(F.array(*rows)))
    return out.select("item", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"), F.when(F.col("ok"), F.col("max_score")).otherwise(0).alias("score"), "max_score")


# The checks of a run with their points, and the columns they ask for.
CHECKS = {
    "Data Collection & Understanding": 2, "Data Preprocessing": 2, "Association Rule Mining": 2, "Link Analysis (PageRank/HITS)": 2,
    "Visualization": 1, "Report & Presentation": 1, "BERT / Semantic Analysis": 5,
}
CLEANED = ("name", "stars", "forks", "language", "topics", "description", "tech_stack", "bert_category", "bert_confidence", "cluster_id", "pca_x", "pca_y", "html_url")
MEASURES = ("support", "confidence", "lift", "conviction", "leverage")
RANKS = ("pagerank", "hub", "authority", "community")


def validation_checks(raw: DataFrame, repos: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame, neighbours: DataFrame, stats: dict, shown: bool, reported: bool, looked_at: int | None = 200) -> DataFrame:
    """(item, status, score, max_score): the seven checks of a run, 15 points in all.

    stats: total_repos, total_categories and embedding_method as recorded. ``shown`` and
    ``reported`` say whether the page and the notebook, and the report and the slides, are there.
    Stacks are checked on the first ``looked_at`` records by stars and name, None: on all.
    """
    first = repos if looked_at is None or "tech_stack" not in repos.columns else repos.orderBy(F.desc_nulls_last("stars"), "name").limit(looked_at)
    count = F.count(F.lit(1))
    sizes = {
        "raw": raw.agg(count), "repos": repos.agg(count), "nodes": nodes.agg(count), "edges": edges.agg(count), "rules": rules.agg(count),
        "collected": repos.agg(F.count_if(F.col("data_origin") == "github_api")), "lists": neighbours.agg(F.count_distinct("name")),
        "bare": first.agg(F.count_if(F.coalesce(F.size("tech_stack"), F.lit(0)) <= 0)) if "tech_stack" in repos.columns else repos.agg(count),
    }
    one = None
    for name, df in sizes.items():
        row = df.toDF(name)
        one = row if one is None else one.join(F.broadcast(row))  # a row each
    total = F.lit(stats.get("total_repos"))
    met = (
        (F.col("collected") > 0) & (F.col("raw") == F.col("repos")) & (F.col("repos") == total),
        F.lit(not missing_columns(repos, CLEANED)) & (F.col("bare") == 0),
        (F.col("rules") >= 100) & F.lit(not missing_columns(rules, MEASURES)),
        (F.col("nodes") >= 20) & (F.col("edges") >= 100) & F.lit(not missing_columns(nodes, RANKS)),
        F.lit(shown),
        F.lit(reported),
        F.lit("embedding_method" in stats and stats.get("total_categories", 0) >= 5) & (F.col("lists") == F.col("repos")),
    )
    rows = [F.struct(F.lit(n).alias("item"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(m).alias("max_score")) for (n, m), ok in zip(CHECKS.items(), met, strict=True)]
    out = one.select(F.inline(F.array(*rows)))
    return out.select("item", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"), F.when(F.col("ok"), F.col("max_score")).otherwise(0).alias("score"), "max_score")
