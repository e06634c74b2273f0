"""Helpers that keep joins against dictionaries and id sets safe under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.storage import cut

#: At most this many dictionary rows are broadcast, whatever the data.
HOT_KEYS = 1000
#: Id sets up to this many rows are broadcast after they were counted.
BROADCAST_IDS = 1_000_000


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dictionary_join(big: DataFrame, words: DataFrame, keys: list[str], values: list[str], weight: str, hot: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``big`` with a dictionary whose keys may be very unevenly used.

    The ``hot`` dictionary rows of greatest ``weight`` (how many rows of ``big`` use
    them) are broadcast: a fixed number of rows. Every other key stands for at most
    1/``hot`` of the rows and goes through a shuffled join; rows already served are
    spread over all partitions by a hash that no dictionary key has. ``keys`` must be
    unique in ``words`` and not null.
    """
    names = {v: f"__hot_{v}" for v in values}
    top = words.orderBy(F.col(weight).desc(), *keys).limit(hot)
    top = top.select(*keys, *[F.col(v).alias(n) for v, n in names.items()], F.lit(True).alias("__served"))
    code = F.xxhash64(*keys)
    served = big.join(F.broadcast(top), keys, "left")
    served = served.withColumn("__lane", F.when(F.col("__served"), F.xxhash64(*big.columns, F.lit("lane")))).withColumn("__code", F.coalesce(F.col("__lane"), code))
    rest = words.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[F.col(v).alias(f"__cold_{v}") for v in values], code.alias("__cold_code"))
    match = (F.col("__code") == F.col("__cold_code")) & F.col("__served").isNull()
    for k in keys:
        match &= F.col(k) == F.col(f"__key_{k}")
    joined = served.join(rest, match, "left").filter(F.col("__served") | F.col("__cold_code").isNotNull())
    plain = [c for c in big.columns]
    return joined.select(*plain, *[F.coalesce(n, f"__cold_{v}").alias(v) for v, n in names.items()])


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``; broadcast only if counted small."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def numbered(df: DataFrame, key: str, lanes: int = 64) -> DataFrame:
    """Adds ``number``: 0, 1, 2 ... in the order of ``key``, without one big sort task.

    Rows are dealt to ranges of the order, which are ranked apart and start where those
    before them end. Equal keys are numbered in any order.
    """
    dealt = df.repartitionByRange(lanes, key).sortWithinPartitions(key)
    placed = cut(dealt.withColumns({"__lane": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("__lane").agg(F.count(F.lit(1)).alias("n"))  # at most ``lanes`` rows
    starts = sizes.selectExpr("__lane", "coalesce(sum(n) OVER (ORDER BY __lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __start")
    return placed.join(F.broadcast(starts), "__lane").withColumn("number", F.col("__start") + F.col("__place")).select(*df.columns, "number")


def folded(column: Column) -> Column:
    """Lower case, without outer spaces, tabs and no-break spaces."""
    return F.btrim(F.lower(column), F.lit(" \t "))


def folded_set(column: Column) -> Column:
    """The sorted distinct folded values of an array, without nulls and blanks; [] for null."""
    clean = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), folded), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(clean))


def current_rows(repos: DataFrame, *columns: str) -> DataFrame:
    """For each non-null name the row with the greatest (collected_at, row_id).

    A missing collected_at counts as earliest. One aggregation with map-side
    combination, so a name collected very often does not fill a single task.
    Returns name, row_id and ``columns``; rows equal in both keys are resolved by the
    greatest remaining values.
    """
    keep = list(dict.fromkeys(["collected_at", "row_id", *columns]))
    newest = repos.filter(F.col("name").isNotNull()).groupBy("name").agg(F.max(F.struct(*keep)).alias("newest"))
    return newest.select("name", *[F.col(f"newest.{c}").alias(c) for c in keep if c != "collected_at" or c in columns])
