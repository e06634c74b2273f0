"""Aggregate statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import dictionary_join, semi_by_ids
from stacklore.storage import cut


def freq_table(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of every value of a column; null counts as a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, count) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def top_n_freq(df: DataFrame, column: str, n: int, order: str) -> DataFrame:
    """The ``n`` most frequent values; of equals the one seen first by ``order``."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("count"), "first").limit(n).select("value", "count")


#: Ranges of values in which places are counted.
LANES = 64


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(field, share, value): interpolated quantiles of numbers, exact, of any number of rows.

    Equal values of a field are counted first. The distinct ones are dealt to LANES ranges by
    their order; a range knows how many rows come before it, so each place is found
    where it lies and no task holds all values. Nulls are left out; a field without values has
    no rows.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])
    values = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    laned = cut(values.repartitionByRange(LANES, "field", "v").withColumn("lane", F.spark_partition_id()))
    sizes = laned.groupBy("field", "lane").agg(F.sum("n").alias("size"))  # at most LANES rows and one for each field
    starts = sizes.selectExpr("field", "lane", "sum(size) OVER (PARTITION BY field) AS total", "coalesce(sum(size) OVER (PARTITION BY field ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start")
    wanted = starts.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("at", F.col("share") * (F.col("total") - 1))
    wanted = wanted.select("field", "lane", "start", "share", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"))
    inside = laned.selectExpr("*", "sum(n) OVER (PARTITION BY field, lane ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto")
    met = inside.join(F.broadcast(wanted), ["field", "lane"])
    first, last = F.col("start") + F.col("upto") - F.col("n"), F.col("start") + F.col("upto") - 1  # places of the value
    hit = met.select("field", "share", "at", "low", F.when((first <= F.col("low")) & (F.col("low") <= last), F.col("v")).alias("a"), F.when((first <= F.col("high")) & (F.col("high") <= last), F.col("v")).alias("b"))
    ends = hit.groupBy("field", "share", "at", "low").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return ends.select("field", "share", (F.col("a") + (F.col("at") - F.col("low")) * (F.col("b") - F.col("a"))).alias("value"))


def _by_field(df: DataFrame, columns: list[str], shares: dict[str, float]) -> DataFrame:
    """(field, a column for each share): the quantiles; fields without values are absent."""
    found = exact_quantiles(df, columns, list(shares.values()))
    return found.groupBy("field").agg(*[F.max(F.when(F.abs(F.col("share") - s) < 1e-12, F.col("value"))).alias(n) for n, s in shares.items()])


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, total, mean, median, max) of numbers; mean and median to 2 places, the median exact."""
    def one(c: str) -> Column:
        return F.struct(F.lit(c).alias("field"), F.sum(c).alias("total"), F.round(F.avg(c), 2).alias("mean"), F.max(c).alias("max"))

    rows = df.agg(F.array(*[one(c) for c in columns]).alias("rows")).select(F.inline("rows"))
    return rows.join(F.broadcast(_by_field(df, columns, {"median": 0.5})), "field", "left").select("field", "total", "mean", F.round("median", 2).alias("median"), "max")  # a row per field


def mean_of(df: DataFrame, column: str, places: int = 4) -> DataFrame:
    return df.agg(F.round(F.avg(column), places).alias("mean"))


def trend_counts(df: DataFrame, items: str, year: str, top: DataFrame) -> DataFrame:
    """(item, year, count) for the items of the table ``top``(item), of any size."""
    rows = df.select(F.explode(F.array_distinct(items)).alias("item"), F.col(year).alias("year"))
    return semi_by_ids(rows, top.select("item").distinct(), "item").groupBy("item", "year").agg(F.count(F.lit(1)).alias("count"))


def trend_pivot(counts: DataFrame, items: list[str]) -> DataFrame:
    """A row per year, a column per item, 0 where there is no count."""
    return counts.groupBy("year").pivot("item", items).agg(F.sum("count")).na.fill(0)


def confidence_histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bucket, count) of shares in [0, 1]; every bucket is there, values outside go to the ends, nulls nowhere."""
    place = F.least(F.greatest(F.floor(F.col(column) * buckets), F.lit(0)), F.lit(buckets - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").na.fill(0, ["count"])


def width_histogram(df: DataFrame, column: str, bins: int, high_quantile: float | None = None) -> DataFrame:
    """(bin, low, high, count): ``bins`` equal widths from the least to the greatest value, the last closed.

    With ``high_quantile`` values above that exact quantile are set to it first. All
    values equal: one bin around them, half a unit each way, as wide as asked for.
    """
    v = F.col(column).cast("double")
    bounds = df.agg(F.min(v).alias("low"), F.max(v).alias("high"))  # one row
    if high_quantile is not None:
        bounds = bounds.select("low").join(F.broadcast(quantile(df, column, high_quantile).select(F.col("quantile").alias("high"))))
    flat = F.col("low") == F.col("high")
    bounds = bounds.select(F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    rows = df.select(v.alias("v")).filter(F.col("v").isNotNull()).join(F.broadcast(bounds))
    place = F.least(F.floor((F.least("v", "high") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(bounds))
    step = (F.col("high") - F.col("low")) / bins
    out = every.join(counts, "bin", "left").na.fill(0, ["count"])
    return out.select("bin", (F.col("low") + F.col("bin") * step).alias("low"), (F.col("low") + (F.col("bin") + 1) * step).alias("high"), "count")


def describe_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, count, mean, std, min, q25, q50, q75, max); quartiles interpolated, std of a sample."""
    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("field"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))

    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    rows = df.agg(F.array(*[one(c) for c in columns]).alias("rows")).select(F.inline("rows"))
    return rows.join(F.broadcast(_by_field(df, columns, quarters)), "field", "left").select("field", "count", "mean", "std", "min", *quarters, "max")  # a row per field


def quantile(df: DataFrame, column: str, share: float) -> DataFrame:
    """(quantile): one row, null without values."""
    return exact_quantiles(df, [column], [share]).agg(F.max("value").alias("quantile"))


def missing_ratio(df: DataFrame, top: int = 12) -> DataFrame:
    """(field, ratio): the share of nulls of each column, the greatest ``top``; ties by name."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("ratio")) for c in df.columns])
    return df.agg(rows.alias("rows")).select(F.inline("rows")).orderBy(F.desc("ratio"), "field").limit(top)


def crosstab(df: DataFrame, rows: str, columns: str, top: int = 10) -> DataFrame:
    """(row, column, count) with the ``top`` most frequent columns, 0 included: the long form of a cross table."""
    keep = df.filter(F.col(columns).isNotNull()).groupBy(F.col(columns).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    keep = keep.orderBy(F.desc("n"), "column").limit(top).select("column")
    names = df.filter(F.col(rows).isNotNull()).select(F.col(rows).alias("row")).distinct()
    counts = df.groupBy(F.col(rows).alias("row"), F.col(columns).alias("column")).agg(F.count(F.lit(1)).alias("count"))
    grid = names.join(F.broadcast(keep))  # ``top`` rows
    return grid.join(counts, ["row", "column"], "left").na.fill(0, ["count"])


def pivot_crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """The wide form, a column per given value."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def group_summary(df: DataFrame, keys: list[str], count: str, rank: str) -> DataFrame:
    """Members, total ``count`` and greatest ``rank`` by group, the largest groups first."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum(count).alias("total"), F.max(rank).alias("best"))
    return out.orderBy(F.desc("members"), F.desc("total"), *keys)


def group_argmax(df: DataFrame, key: str, rank: str, name: str) -> DataFrame:
    """(key, name): the member of greatest ``rank`` in each group, the first by name of equals."""
    return df.groupBy(key).agg(F.min_by(name, F.struct(-F.col(rank), F.col(name))).alias(name))


def mode(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the most frequent value, null left out; the least of equals."""
    return freq_table(df.filter(F.col(column).isNotNull()), column).orderBy(F.desc("count"), "value").limit(1)


def quality_metrics(df: DataFrame, name: str = "name", counts: tuple[str, ...] = ("stars", "forks"), confidence: str = "bert_confidence", stack: str = "tech_stack", text: str = "description") -> DataFrame:
    """(metric, value): duplicates, blanks, negative counts and values out of range, in one pass."""
    checks: dict[str, Column] = {
        "rows": F.count(F.lit(1)),
        "duplicate_names": F.count(name) - F.count_distinct(name),
        **{f"negative_{c}": F.count_if(F.col(c) < 0) for c in counts},
        "confidence_out_of_range": F.count_if((F.col(confidence) < 0) | (F.col(confidence) > 1)),
        "empty_stacks": F.count_if(F.coalesce(F.size(stack), F.lit(0)) <= 0),
        "blank_texts": F.count_if(F.trim(F.coalesce(text, F.lit(""))) == ""),
        "unique_languages": F.count_distinct("language"),
    }
    return _unpivot(df.agg(*[c.cast("bigint").alias(n) for n, c in checks.items()]), list(checks))


def _unpivot(one_row: DataFrame, names: list[str], kind: str = "metric") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(kind), F.col(n).alias("value")) for n in names])
    return one_row.select(F.inline(pairs))


def kpis(repos: DataFrame, nodes: DataFrame, edges: int, rules: int) -> DataFrame:
    """(metric, value): the totals of a run. ``edges`` and ``rules`` are those exported."""
    spark = repos.sparkSession
    one = repos.agg(F.count(F.lit(1)).alias("total_repos"), F.count_distinct("bert_category").alias("total_categories"))
    two = nodes.agg(F.count(F.lit(1)).alias("total_technologies"), F.count_distinct("community").alias("total_communities"))
    given = spark.createDataFrame([("total_edges", edges), ("total_rules", rules)], "metric string, value bigint")
    parts = [_unpivot(one, ["total_repos", "total_categories"]), _unpivot(two, ["total_technologies", "total_communities"]), given]
    return reduce(DataFrame.unionByName, parts)


def insights(nodes: DataFrame, rules: DataFrame, repos: DataFrame) -> DataFrame:
    """(place, text): the most central item, the strongest rule, the largest category; only those that exist."""
    central = nodes.orderBy(F.desc("pagerank"), F.desc("count"), "id").limit(1)
    first = central.select(F.lit(1).alias("place"), F.format_string("%s is the most central technology by PageRank, appearing in %s repositories.", "id", F.col("count").cast("string")).alias("text"))
    best = rules.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support_count"), "antecedent", "consequent").limit(1)
    sides = [F.array_join(s, " + ") for s in ("antecedent", "consequent")]
    second = best.select(F.lit(2).alias("place"), F.format_string("The strongest association rule is %s -> %s with lift %s and confidence %s.", *sides, F.col("lift").cast("string"), F.col("confidence").cast("string")).alias("text"))
    most = mode(repos, "bert_category")
    third = most.select(F.lit(3).alias("place"), F.format_string("%s is the largest semantic category with %s repositories.", "value", F.col("count").cast("string")).alias("text"))
    return first.unionByName(second).unionByName(third)


def lookup_counts(rows: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` from counts(key, value), where few keys may hold most rows."""
    return dictionary_join(rows, counts, [key], [value], value)
