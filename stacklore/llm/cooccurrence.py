"""Problem 1: how often items appear together, against chance.

Large-basket blocking: a basket of up to ``block`` items yields its pairs where it
stands. A larger one is cut into chunks of ``block`` items; every pair of chunks is a
row of its own, spread over the tasks, and yields the products of its two chunks. Both
kinds of pairs meet in one count with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import dictionary_join

BLOCK = 128


def _products(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (item_a < item_b) of rows(by, left, right, same); left precedes right."""
    one = rows.select(*by, "left", "right", "same", F.posexplode("left").alias("at", "item_a"))
    partners = F.when(F.col("same"), F.slice("left", F.col("at") + 2, F.size("left"))).otherwise(F.col("right"))
    return one.select(*by, "item_a", F.explode(partners).alias("item_b"))


def basket_pairs(baskets: DataFrame, by: list[str], id_col: str, items: str, block: int = BLOCK) -> DataFrame:
    """One row (by, item_a, item_b) per basket and pair of its items, item_a < item_b.

    ``items`` must be sorted and distinct. Null or empty baskets yield nothing.
    """
    rows = baskets.select(*by, F.col(id_col).alias("__basket"), F.col(items).alias("__items")).filter(F.size("__items") > 1)
    small = rows.filter(F.size("__items") <= block).select(*by, F.col("__items").alias("left"), F.col("__items").alias("right"), F.lit(True).alias("same"))
    big = rows.filter(F.size("__items") > block).groupBy(*by, "__basket", "__items").agg(F.count(F.lit(1)).alias("__copies"))  # equal rows go through once
    count = F.ceil(F.size("__items") / block).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("__items", i * block + 1, block))  # sliced before rows are made, so that a row holds one chunk
    chunk = big.select(*by, "__basket", F.xxhash64("__items").alias("__sum"), "__copies", count.alias("__n"), F.posexplode(parts).alias("__i", "__chunk"))
    chunk = chunk.repartition(*by, "__basket", "__i")
    chunk = chunk.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    key = [*by, "__basket", "__sum", F.least("__i", "__j").alias("__low"), F.greatest("__i", "__j").alias("__high")]
    met = chunk.groupBy(*key).agg(
        F.max(F.when(F.col("__i") <= F.col("__j"), F.col("__chunk"))).alias("left"),
        F.max(F.when(F.col("__i") >= F.col("__j"), F.col("__chunk"))).alias("right"),
        F.max("__copies").alias("__copies"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    large = met.select(*by, "left", "right", (F.col("__low") == F.col("__high")).alias("same"), copies).drop("__copy")
    return _products(small, by).unionByName(_products(large, by))


def cooccurrence(baskets: DataFrame, by: list[str], id_col: str, items: str, min_count: int = 1, min_share: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Counts and association scores of all item pairs, within each ``by`` group.

    Columns: by, item_a, item_b, n_both, n_a, n_b, n_baskets, lift, pmi, llr. n_baskets
    counts baskets with an item; ``min_count`` and ``min_share`` (of n_baskets) leave out
    pairs that occur less often, after counting. pmi is log2 of lift; llr is the
    log-likelihood ratio of the pair's two-by-two table. Repeated rows are baskets of
    their own. An empty table gives an empty result.
    """
    rows = baskets.filter(F.size(items) > 0).select(*by, id_col, items)
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_baskets"))
    single = rows.select(*by, F.explode(items).alias("item")).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n"))
    pairs = basket_pairs(rows, by, id_col, items, block).groupBy(*by, "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = pairs.join(F.broadcast(total), by)  # one row per table that is counted
    pairs = pairs.filter((F.col("n_both") >= min_count) & (F.col("n_both") >= F.ceil(F.lit(min_share) * F.col("n_baskets"))))
    for side in ("a", "b"):
        words = single.select(*by, F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = dictionary_join(pairs, words, [*by, f"item_{side}"], [f"n_{side}"], f"n_{side}")
    n, c, a, b = (F.col(x).cast("double") for x in ("n_baskets", "n_both", "n_a", "n_b"))
    lift = c * n / (a * b)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    llr = 2 * (part(c, a * b / n) + part(a - c, a * (n - b) / n) + part(b - c, (n - a) * b / n) + part(n - a - b + c, (n - a) * (n - b) / n))
    return pairs.select(*by, "item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log2(lift).alias("pmi"), llr.alias("llr"))
