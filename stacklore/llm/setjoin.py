"""Problem 6: all similar pairs between set-valued records.

Exact signature join. Equal sets are one class. The values of a set are ordered from
rare to frequent; two sets that overlap in at least o values share three of the first
n - o + 3, so every set is indexed under the triples of that prefix, and only sets that
share a triple are compared. Sets above SMALL values use single values in place of
triples. README.md says why one-bit sketches with joined code segments, the method
asked for, do not reach the result at this threshold.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import HOT_KEYS
from stacklore.storage import cut

#: Up to this many values a set is indexed under triples.
SMALL = 16
#: Sets that meet under a code in one task; more are dealt to blocks.
SHARD = 20_000


def _triples(prefix: Column) -> Column:
    """Hashes of all 3-combinations of an array, in its order."""

    def second(x, i):
        return F.flatten(F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda y, j: F.transform(F.slice(prefix, i + j + 3, F.size(prefix)), lambda z: F.xxhash64(x, y, z))))

    return F.flatten(F.transform(prefix, second))


def similar_sets(sets: DataFrame, by: list[str], items: str, similarity: Fraction = Fraction(3, 5), min_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal sets, and the classes' members.

    sets(by, id, items): ``items`` sorted and distinct. Sets of fewer than ``min_size``
    values or without an id do not take part. Returns links(by, rep_a, rep_b, shared, united) with
    shared / united >= ``similarity``, rep_a < rep_b, and members(by, id, rep), where
    rep is the least id of a class. Every pair at the threshold is found. To join two
    tables, give both with a column that tells them apart and keep the links across.
    """
    up, down = similarity.numerator, similarity.denominator
    rows = sets.filter((F.size(items) >= min_size) & F.col("id").isNotNull()).select(*by, "id", F.col(items).alias("items"))
    classes = cut(rows.groupBy(*by, "items").agg(F.min("id").alias("rep")))
    members = rows.join(classes, [*by, "items"]).select(*by, "id", "rep")

    # Any fixed order of the values gives the whole result; the most frequent HOT_KEYS come last.
    value = classes.select(*by, "rep", F.size("items").alias("n"), F.explode("items").alias("value"))
    counted = value.groupBy("value").agg(F.count(F.lit(1)).alias("rank"))
    top = counted.orderBy(F.col("rank").desc(), "value").limit(HOT_KEYS)
    ranked = value.join(F.broadcast(top), "value", "left")  # HOT_KEYS rows
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.col("value"))))
    ordered = ranked.groupBy(*by, "rep", "n").agg(F.transform(order, lambda x: x["value"]).alias("items"))

    n = F.col("n").cast("bigint")
    overlap = F.floor((n * up + down - 1) / down)  # with any partner
    least = -(-2 * min_size * up // (up + down))
    triple_length = F.least(n, n - F.greatest(overlap, F.lit(least)) + 3).cast("int")
    if least < 3:
        raise ValueError("sets this small or unlike cannot be indexed under triples")
    small = ordered.filter(F.col("n") <= SMALL).select(*by, "rep", "n", F.explode(_triples(F.slice("items", F.lit(1), triple_length))).alias("code"))
    single = ordered.filter(F.col("n") * down >= up * (SMALL + 1)).select(*by, "rep", "n", F.explode(F.transform(F.slice("items", F.lit(1), (n - overlap + 1).cast("int")), lambda x: F.xxhash64(x))).alias("code"))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of a and b that share a code; the members of a hot code meet in blocks."""
        hot = b.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > SHARD)
        hot = cut(hot.select(*by, "code", F.ceil(F.col("uses") / SHARD).cast("int").alias("parts")))
        part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        if hot.limit(1).count():
            a = a.join(hot, [*by, "code"], "left").na.fill(1, ["parts"]).select(*a.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            b = b.join(hot, [*by, "code"], "left").na.fill(1, ["parts"]).select(*b.columns, part.alias("part"))
        else:
            a, b = a.withColumn("part", F.lit(0)), b.withColumn("part", F.lit(0))
        left = a.select(*by, "code", "part", F.col("rep").alias("rep_a"), F.col("n").alias("n_a"))
        right = b.select(*by, "code", "part", F.col("rep").alias("rep_b"), F.col("n").alias("n_b"))
        near = F.least("n_a", "n_b") * down >= F.greatest("n_a", "n_b") * up
        return left.join(right, [*by, "code", "part"]).filter(near & (F.col("rep_a") != F.col("rep_b")))

    # Sets up to SMALL meet each other under triples; a larger one meets all under single values.
    met = meet(small, small).filter(F.col("rep_a") < F.col("rep_b")).unionByName(meet(single.filter(F.col("n") > SMALL), single))
    met = met.select(*by, F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()
    for side in "ab":
        met = met.join(classes.select(*by, F.col("rep").alias(f"rep_{side}"), F.col("items").alias(f"items_{side}")), [*by, f"rep_{side}"])
    shared = F.size(F.array_intersect("items_a", "items_b"))
    met = met.withColumn("shared", shared).withColumn("united", F.size("items_a") + F.size("items_b") - F.col("shared"))
    links = met.filter(F.col("shared") * down >= F.col("united") * up).select(*by, "rep_a", "rep_b", "shared", "united")
    return links, members
