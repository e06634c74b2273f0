"""The interactive query layer: filters, search, pages, samples, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.scalars import search_blob

PAGE = 60
_SEARCHED = ("name", "language", "bert_category", "popularity", "topics", "tech_stack", "description")


def with_search(repos: DataFrame) -> DataFrame:
    """Adds ``search``, the text that queries look into; persist it to query often."""
    return repos.withColumn("search", search_blob(*[F.col(c) for c in _SEARCHED]))


def matching(repos: DataFrame, category: str | None = None, language: str | None = None, popularity: str | None = None, query: str | None = None) -> DataFrame:
    """Records that meet every given condition; the query is a literal part of ``search``, any case."""
    given = {"bert_category": category, "language": language, "popularity": popularity}
    tests: list[Column] = [F.col(c) == v for c, v in given.items() if v is not None]
    if query and query.strip():
        tests.append(F.contains(search_blob(*[F.col(c) for c in _SEARCHED]), F.lit(query.strip().lower())))
    return repos.filter(reduce(Column.__and__, tests)) if tests else repos


def explorer_page(repos: DataFrame, page: int = 1, size: int = PAGE, **conditions: str | None) -> DataFrame:
    """A page of the matching records by stars descending and name; ``page`` is moved into the range there is."""
    rows = matching(repos, **conditions)
    last = max(1, -(-rows.count() // size))
    at = max(1, min(page, last))
    return rows.orderBy(F.desc_nulls_last("stars"), "name").offset((at - 1) * size).limit(size)


def systematic_sample(df: DataFrame, order: list[str], most: int = 4200) -> DataFrame:
    """Every k-th row by ``order``, k the least step that leaves up to ``most`` rows.

    Places are counted per range of the order and shifted by the sizes of the ranges
    before it, so no task sorts everything.
    """
    from stacklore.storage import cut

    step = max(1, -(-df.count() // most))
    lanes = df.repartitionByRange(64, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laned = cut(lanes.withColumns({"__lane": F.spark_partition_id(), "__row": row}))
    sizes = laned.groupBy("__lane").agg(F.count(F.lit(1)).alias("n"))  # at most 64 rows
    starts = sizes.selectExpr("__lane", "coalesce(sum(n) OVER (ORDER BY __lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __start")
    return laned.join(F.broadcast(starts), "__lane").filter((F.col("__row") + F.col("__start")) % step == 0).drop("__lane", "__row", "__start")


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = 12) -> DataFrame:
    """``n`` rows in the order of a hash of their id: always the same ones for a seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(n)


def top_repositories(repos: DataFrame, n: int = 25) -> DataFrame:
    """By stars, forks and name."""
    return repos.orderBy(F.desc_nulls_last("stars"), F.desc_nulls_last("forks"), "name").limit(n).select("name", "stars", "forks", "language", F.col("bert_category").alias("category"), F.col("html_url").alias("url"))


def recommendations(similarities: DataFrame, repos: DataFrame, name: str | None = None, top: int = 8) -> DataFrame:
    """The neighbours of one record (of all, for None) with their attributes; unknown names give no rows.

    similarities(name, neighbour, neighbour_no, score); repeated rows count once, of the
    same neighbour the best score. Neighbours missing from ``repos`` keep null attributes.
    """
    rows = similarities.filter(F.col("name") == name) if name is not None else similarities
    rows = rows.filter(F.col("neighbour_no") <= top).groupBy("name", "neighbour").agg(F.min("neighbour_no").alias("neighbour_no"), F.max("score").alias("score"))
    attributes = repos.select(F.col("name").alias("neighbour"), "language", "bert_category", "stars", "description", "html_url")
    return rows.join(attributes, "neighbour", "left").select("name", "neighbour_no", "neighbour", "score", "language", "bert_category", "stars", "description", "html_url")


def neighbour_lists(similarities: DataFrame) -> DataFrame:
    """(name, neighbours array<struct<neighbour, score>>) in the order of neighbour_no: the exported form."""
    rows = similarities.groupBy("name", "neighbour").agg(F.min("neighbour_no").alias("no"), F.max("score").alias("score"))
    listed = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("no", "neighbour", "score"))).alias("all"))
    return listed.select("name", F.transform("all", lambda x: F.struct(x["neighbour"].alias("neighbour"), x["score"].alias("score"))).alias("neighbours"))


def extent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, low, high) of the given columns."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")) for c in columns])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))
