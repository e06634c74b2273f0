"""Frequent itemsets and association rules, exact, over transactions(id, items)."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.storage import cut

RULE_COLUMNS = ("antecedent", "consequent", "support", "support_count", "confidence", "lift", "conviction", "leverage", "antecedent_count", "consequent_count")


def min_count(n: int, support: float) -> int:
    """Transactions that hold a frequent itemset: ceil(support * n), at least 2."""
    return max(2, math.ceil(support * n))


def frequent_itemsets(tx: DataFrame, support: float = 0.012, size: int = 3) -> DataFrame:
    """(items, size, count, n) of all itemsets up to ``size`` in ceil(support * n) transactions, at least 2.

    Level by level: only transactions cut down to frequent items are combined, and a
    larger set only from a frequent smaller one and a later item, which leaves out nothing
    (a part of a frequent set is frequent). Counts combine on the map side.
    """
    tx = tx.filter(F.size("items") > 0)
    n = tx.count()
    least = min_count(n, support)
    single = cut(tx.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least))
    levels = [single.select(F.array("item").alias("items"), F.lit(1).alias("size"), "count")]
    flat = tx.select("id", F.explode("items").alias("item")).join(single.select("item"), "item")
    kept = cut(flat.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1))
    prefix = kept.select("id", "items", F.posexplode("items").alias("at", "last")).select("id", "items", "at", F.array("last").alias("set"))
    for k in range(2, size + 1):
        longer = _extend(prefix)
        counts = cut(longer.groupBy("set").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least))
        levels.append(counts.select(F.col("set").alias("items"), F.lit(k).alias("size"), "count"))
        if k < size:
            prefix = cut(longer.join(counts.select("set"), "set", "left_semi").select("id", "items", "at", "set"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.withColumn("n", F.lit(n).cast("bigint"))


def _extend(prefix: DataFrame) -> DataFrame:
    """Each set of a transaction with each later item of it."""
    later = F.slice("items", F.col("at") + 2, F.size("items"))
    rows = prefix.select("id", "items", "at", "set", F.posexplode(later).alias("step", "next"))
    return rows.select("id", "items", (F.col("at") + F.col("step") + 1).alias("at"), F.array_append("set", F.col("next")).alias("set"))


def itemset_summary(itemsets: DataFrame, support: float, size: int = 3) -> DataFrame:
    """(name, value): how many itemsets of each size there are, and the least count asked for."""
    spark = itemsets.sparkSession
    n = itemsets.agg(F.max("n").alias("n")).first()["n"] or 0
    counts = itemsets.groupBy("size").agg(F.count(F.lit(1)).alias("value"))
    names = spark.range(1, size + 1).select(F.col("id").cast("int").alias("size"))
    rows = names.join(counts, "size", "left").select(F.format_string("frequent_%d_itemsets", "size").alias("name"), F.coalesce("value", F.lit(0)).alias("value"))
    return rows.unionByName(spark.range(1).select(F.lit("min_support_count").alias("name"), F.lit(min_count(n, support)).cast("bigint").alias("value")))


def association_rules(itemsets: DataFrame, confidence: float = 0.25, lift: float = 1.1, size: int = 3) -> DataFrame:
    """The rules of frequent itemsets with their measures; consequents of several items too.

    Confidence and lift are tested before they are rounded to 5 places. Sorted by rounded
    lift and confidence descending, support count descending, then antecedent and consequent.
    """
    splits = []
    for k in range(2, size + 1):
        for m in range(1, k):
            splits += [(k, list(c), [i for i in range(k) if i not in c]) for c in combinations(range(k), m)]

    def part(places):
        return F.array(*[F.col("items")[i] for i in places])

    sides = None
    for k in sorted({s[0] for s in splits}):
        rows = itemsets.filter(F.col("size") == k)
        pairs = F.array(*[F.struct(part(a).alias("antecedent"), part(b).alias("consequent")) for s, a, b in splits if s == k])
        rows = rows.select("count", "n", F.inline(pairs))
        sides = rows if sides is None else sides.unionByName(rows)
    for side in ("antecedent", "consequent"):
        sides = sides.join(itemsets.select(F.col("items").alias(side), F.col("count").alias(f"{side}_count")), side)
    n, c, a, b = (F.col(x).cast("double") for x in ("n", "count", "antecedent_count", "consequent_count"))
    conf, share = c / a, b / n
    ratio = conf / share
    conviction = F.when(conf < 1, (1 - share) / (1 - conf)).otherwise(999.0)
    rules = sides.filter((conf >= confidence) & (ratio >= lift)).select(
        "antecedent", "consequent", F.round(c / n, 5).alias("support"), F.col("count").alias("support_count"), F.round(conf, 5).alias("confidence"),
        F.round(ratio, 5).alias("lift"), F.round(conviction, 5).alias("conviction"), F.round(c / n - a / n * share, 5).alias("leverage"), "antecedent_count", "consequent_count",
    )
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support_count"), "antecedent", "consequent")


def rule_tiers(rules: DataFrame, least: int) -> DataFrame:
    """Adds tier, by lift 10, confidence 0.8 and ``least`` transactions, or by lift 3 and confidence 0.5."""
    strong = (F.col("lift") >= 10) & (F.col("confidence") >= 0.8) & (F.col("support_count") >= least)
    useful = (F.col("lift") >= 3) & (F.col("confidence") >= 0.5)
    return rules.withColumn("tier", F.when(strong, "strong stack signal").when(useful, "useful recommendation").otherwise("exploratory"))


def best_tier(tiered: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` rules of the best tier that there is, by count, lift and confidence."""
    place = F.when(F.col("tier") == "strong stack signal", 0).when(F.col("tier") == "useful recommendation", 1).otherwise(2)
    ranked = tiered.withColumn("__place", place)
    best = ranked.agg(F.min("__place").alias("__best"))  # one row
    # exploratory means that no other tier is there, so then all rules are shown
    kept = ranked.join(F.broadcast(best)).filter(F.col("__place") == F.col("__best")).drop("__place", "__best")
    return kept.orderBy(F.desc("support_count"), F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(n)


def recommend_stack(rules: DataFrame, have: list[str], n: int = 10) -> DataFrame:
    """Rules whose antecedent holds all of ``have``, by lift and confidence."""
    own = F.array(*[F.lit(x) for x in have]).cast("array<string>")
    fits = rules.filter(F.size(F.array_except(own, F.col("antecedent"))) == 0).orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(n)
    return fits.select(F.array_join("antecedent", " + ").alias("given"), F.array_join("consequent", " + ").alias("recommend"), "support_count", "confidence", "lift")


def fpgrowth_itemsets(tx: DataFrame, support: float = 0.02, top: int = 15, first: int | None = None) -> DataFrame:
    """(items, size, count, support) of the ``top`` itemsets by FP-growth; ``first`` transactions by id, None: all.

    Of equals the smaller and alphabetically first come first.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = tx.filter(F.size("items") > 0)
    if first is not None:
        rows = rows.orderBy("id").limit(first)
    rows = cut(rows.select("items"))
    n = max(1, rows.count())
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(rows).freqItemsets
    out = found.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("count"), (F.col("freq") / n).alias("support"))
    return out.orderBy(F.desc("count"), "size", "items").limit(top)
