"""Cleaning of collected records, deduplication and export."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.functions import scalars as S
from stacklore.functions.vocabulary import ALIASES, STOPWORDS

EXPORT = (
    "name", "stars", "forks", "watchers", "open_issues", "language", "topics", "description", "tech_stack", "created_year", "era", "popularity",
    "bert_category", "bert_confidence", "semantic_score", "cluster_id", "pca_x", "pca_y", "license", "html_url", "data_origin",
)


def _pick(df: DataFrame, key: str, order: str, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.struct(order, *rest)
    chosen = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.max(row) if last else F.min(row)).alias("__row"))
    return chosen.select(*[F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order`` (nulls first, then the least of the other columns).

    One aggregation with map-side combination, so a key of any frequency is fine. Rows
    with a null key are dropped. Map columns are not supported.
    """
    return _pick(df, key, order, last=False)


def dedup_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; see ``dedup_first``."""
    return _pick(df, key, order, last=True)


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` with the rows of ``new`` added; of equal keys the last of ``new`` wins."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("__at", F.struct("__new", order))
    return dedup_last(both, key, "__at").drop("__new", "__at")


def _or_null(df: DataFrame, *names: str):
    return [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]


def preprocess(raw: DataFrame, order: str, aliases: Mapping[str, str] = ALIASES, stopwords: Iterable[str] = STOPWORDS, description_limit: int | None = None, readme_limit: int | None = None) -> DataFrame:
    """Cleaned records, one per name: the first by ``order``.

    Accepts the alternative columns full_name, readme_snippet, stargazers_count,
    forks_count, watchers_count, open_issues_count and source; other columns pass through.
    Rows without a name are dropped. Blank texts, 0 and null count as missing.
    ``description_limit`` and ``readme_limit`` cut the cleaned texts; None takes them whole.
    """

    def text(*names: str):
        return F.coalesce(*[S.blank_to_null(c) for c in _or_null(raw, *names)])

    named = raw.withColumn("name", S.strip(text("name", "full_name"))).filter(F.col("name") != "")
    one = dedup_first(named, "name", order)
    language = S.language_or_unknown(F.col("language"))
    out = one.withColumns({
        **{n: S.first_count(*_or_null(raw, n, alt)) for n, alt in (("stars", "stargazers_count"), ("forks", "forks_count"), ("watchers", "watchers_count"), ("open_issues", "open_issues_count"))},
        "language": language,
        "topics": S.normalize_topics(F.col("topics"), aliases, stopwords),
        "clean_desc": S.clean_text(F.col("description"), description_limit),
        "clean_readme": S.clean_text(text("readme", "readme_snippet"), readme_limit),
        "created_year": S.parse_year(F.col("created_at")),
        "license": F.coalesce(text("license"), F.lit("Unknown")),
        "html_url": F.coalesce(text("html_url"), F.concat(F.lit("https://github.com/"), F.col("name"))),
        "data_origin": F.coalesce(text("data_origin", "source"), F.lit("unknown")),
    })
    return out.withColumns({
        "tech_stack": S.tech_stack(F.col("topics"), F.col("language")),
        "era": S.era(F.col("created_year")),
        "popularity": S.popularity(F.col("stars")),
        "combined_text": S.combined_text(F.col("clean_desc"), F.col("clean_readme"), F.col("topics"), F.col("language")),
    })


def export_projection(repos: DataFrame, topics: int = 10, description: int = 260, stack: int = 12) -> DataFrame:
    """The exported columns, long values cut, by stars descending and name."""
    cut = {"topics": F.slice("topics", 1, topics), "description": F.substring(F.coalesce("description", F.lit("")), 1, description), "tech_stack": F.slice("tech_stack", 1, stack)}
    return repos.select(*[cut.get(c, F.col(c)).alias(c) for c in EXPORT if c in repos.columns]).orderBy(F.desc("stars"), "name")


def flatten_record(items: DataFrame) -> DataFrame:
    """Flat records of nested search results (full_name, license.spdx_id, owner.type ...)."""

    def date(c: str):
        return F.substring(F.coalesce(F.col(c), F.lit("")), 1, 10).alias(c)

    def number(source: str, name: str):
        return F.coalesce(F.col(source), F.lit(0)).cast("bigint").alias(name)

    def text(source: str, name: str, default: str):
        return F.coalesce(S.blank_to_null(F.col(source)), F.lit(default)).alias(name)

    return items.select(
        F.col("full_name").alias("name"), number("stargazers_count", "stars"), number("forks_count", "forks"), number("watchers_count", "watchers"),
        number("open_issues_count", "open_issues"), number("size", "size_kb"), text("language", "language", "Unknown"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), text("description", "description", ""), F.lit("").alias("readme"),
        text("homepage", "homepage", ""), date("created_at"), date("updated_at"), date("pushed_at"), text("license.spdx_id", "license", "Unknown"),
        "html_url", text("default_branch", "default_branch", "main"), F.coalesce("archived", F.lit(False)).alias("archived"),
        text("owner.type", "owner_type", "Unknown"), F.lit("github_api").alias("data_origin"),
    )
