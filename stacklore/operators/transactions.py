"""Transactions, their items, and the weighted co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklore.functions.tables import HOT_KEYS
from stacklore.storage import cut


def transactions(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """(id, items): the sorted distinct non-null items of each record that has any."""
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).alias("items"))
    return rows.filter(F.size("items") > 0)


def item_counts(tx: DataFrame) -> DataFrame:
    """(item, count, support): in how many transactions each item is."""
    n = tx.agg(F.count(F.lit(1)).alias("n"))
    counts = tx.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(F.broadcast(n)).select("item", "count", (F.col("count") / F.col("n")).alias("support"))  # one row


def average_length(tx: DataFrame) -> DataFrame:
    return tx.agg(F.avg(F.size("items")).alias("average_length"))


def item_pairs(tx: DataFrame) -> DataFrame:
    """(id, source, target): the pairs of items of each transaction, source < target."""
    one = tx.select("id", "items", F.posexplode("items").alias("at", "source"))
    return one.select("id", "source", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("target"))


def cooccurrence_edges(tx: DataFrame) -> DataFrame:
    """(source, target, weight, first_id): how many transactions hold both, and the first that does."""
    return item_pairs(tx).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))


def mirrored(edges: DataFrame) -> DataFrame:
    """(source, target, weight) in both directions."""
    ends = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.source", "e.target", "weight")


def node_degree(edges: DataFrame) -> DataFrame:
    """(id, degree_weight): the sum of the weights of a node's edges."""
    return mirrored(edges).groupBy(F.col("source").alias("id")).agg(F.sum("weight").cast("bigint").alias("degree_weight"))


def top_edges(edges: DataFrame, n: int = 1500) -> DataFrame:
    """The heaviest edges; of equals those seen first, then by their ends."""
    return edges.orderBy(F.desc("weight"), "first_id", "source", "target").limit(n).select("source", "target", "weight")


def strongest_relations(edges: DataFrame, n: int = 25) -> DataFrame:
    return top_edges(edges, n).withColumn("relation", F.concat_ws(" + ", "source", "target"))


#: Records of an item that meet in one task where no limit is set.
RECORD_BLOCK = 2000


def basket_similarity_graph(df: DataFrame, id_col: str, items: str, order: str, top: int | None = 2500, per_item: int | None = 250, edges: int | None = 5000) -> DataFrame:
    """Records linked by shared items: (source, target, weight), the heaviest ``edges`` pairs.

    The ``top`` records by ``order`` take part, and of each item its ``per_item`` first by
    ``order``: these limits are for drawing, None lifts them. Ties go by id; the source comes
    before the target. The records of an item meet in blocks of about RECORD_BLOCK.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(order).alias("o"), F.col(items).alias("items"))
    if top is not None:
        rows = rows.orderBy(F.desc_nulls_last("o"), "id").limit(top)
    place = F.struct(F.col("o").isNull().alias("missing"), (-F.col("o")).alias("o"), "id")
    kept = rows.select("id", place.alias("place"), F.explode(F.array_distinct("items")).alias("item")).filter(F.col("item").isNotNull())
    if per_item is not None:
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("place"))).filter(F.col("r") <= per_item).drop("r")
    kept = cut(kept)
    blocks = kept.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RECORD_BLOCK).select("item", F.ceil(F.col("n") / RECORD_BLOCK).cast("int").alias("blocks"), "n")
    kept = kept.join(F.broadcast(blocks.orderBy(F.desc("n"), "item").limit(HOT_KEYS)), "item", "left").select("id", "place", "item", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    kept = kept.select("id", "place", "item", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    kept = kept.select("id", "place", "item", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    a = kept.select("item", "low", "high", F.col("block").alias("x"), F.col("id").alias("source"), F.col("place").alias("p"))
    b = kept.select("item", "low", "high", F.col("block").alias("y"), F.col("id").alias("target"), F.col("place").alias("q"))
    met = a.join(b, ["item", "low", "high"]).filter((F.col("p") < F.col("q")) & (F.least("x", "y") == F.col("low")) & (F.greatest("x", "y") == F.col("high")))
    pairs = met.groupBy("source", "target", "p", "q").agg(F.count(F.lit(1)).alias("weight"))
    if edges is not None:
        pairs = pairs.orderBy(F.desc("weight"), "p", "q").limit(edges)
    return pairs.select("source", "target", "weight")
