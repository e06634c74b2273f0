"""Classes of exact copies, and links between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.storage import cut


#: Members of a class that are kept together, on average.
BLOCK = 512


def expand(links: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """All pairs of ids (by, id_a < id_b) that the linked classes stand for.

    links(by, rep_a, rep_b): linked classes; members(by, id, rep): every id with its
    class. Two members of one class are a pair as well. Classes are cut into blocks of
    about BLOCK members; pairs of blocks are rows of their own and make their pairs where
    they stand, so that no task gets a large class whole. The result is as large as the
    number of pairs asked for; ``class_links`` is the form that stays small.
    """
    sizes = cut(members.groupBy(*by, "rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    large = sizes.filter(F.col("n") > BLOCK).select(*by, "rep", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    blocks = members.join(large, [*by, "rep"], "left").groupBy(*by, "rep", block.alias("block")).agg(F.collect_list("id").alias("ids"))  # about BLOCK ids
    blocks = cut(blocks)

    def side(name: str) -> list:
        return [*by, F.col("rep").alias(f"rep_{name}")]

    both = links.select(*by, "rep_a", "rep_b").unionByName(sizes.select(*by, F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    for x in "ab":
        both = both.join(large.select(*side(x), F.col("blocks").alias(f"blocks_{x}")), [*by, f"rep_{x}"], "left").na.fill(1, [f"blocks_{x}"])
    same = F.col("rep_a") == F.col("rep_b")
    both = both.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("block_a"))
    both = both.join(blocks.select(*side("a"), F.col("block").alias("block_a"), F.col("ids").alias("ids_a")), [*by, "rep_a", "block_a"])
    first = F.when(same, F.col("block_a")).otherwise(0)
    both = both.select("*", F.explode(F.sequence(first, F.col("blocks_b") - 1)).alias("block_b"))
    both = both.join(blocks.select(*side("b"), F.col("block").alias("block_b"), F.col("ids").alias("ids_b")), [*by, "rep_b", "block_b"])
    both = both.select(*by, (same & (F.col("block_a") == F.col("block_b"))).alias("once"), F.explode("ids_a").alias("x"), "ids_b")
    both = both.select(*by, "once", "x", F.explode("ids_b").alias("y")).filter(~F.col("once") | (F.col("x") < F.col("y")))
    return both.select(*by, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def class_links(links: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """One row per record: its class, the class's size and its number of linked classes."""
    ends = links.select(*by, F.col("rep_a").alias("rep")).unionByName(links.select(*by, F.col("rep_b").alias("rep")))
    degree = ends.groupBy(*by, "rep").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy(*by, "rep").agg(F.count(F.lit(1)).alias("n_copies"))
    of_class = sizes.join(degree, [*by, "rep"], "left").na.fill(0, ["n_links"])
    return members.join(of_class, [*by, "rep"]).select(*by, "id", F.col("rep").alias("class_id"), "n_copies", "n_links")
