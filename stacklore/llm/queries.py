"""The queries pN_... over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklore.functions.tables import current_rows, folded, folded_set, read, semi_by_ids
from stacklore.llm import canonical, cooccurrence, distinctive, encoding, frequency, leakage, markup, neardup, packing, pairs, setjoin
from stacklore.storage import cut


def tag_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(src, id, items): folded topics of the current rows, folded tech_stack of all repos. Worked out once, used several times."""
    topics = current_rows(read(spark, folder, "github_repos").select("name", "collected_at", "row_id", "topics"), "topics")
    topics = topics.select(F.lit("github_repos").alias("src"), F.col("row_id").alias("id"), folded_set(F.col("topics")).alias("items"))
    stacks = read(spark, folder, "repos").select(F.lit("repos").alias("src"), F.col("repo_id").alias("id"), folded_set(F.col("tech_stack")).alias("items"))
    return cut(topics.unionByName(stacks))


def _pairs(spark: SparkSession, folder: str, min_count: int) -> DataFrame:
    scored = cooccurrence.cooccurrence(tag_sets(spark, folder), ["src"], "id", "items", min_count=min_count)
    return scored.select("src", "item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that occur at least twice; p1_all_pairs has all."""
    return _pairs(spark, folder, 2)


def p1_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, 1)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = cooccurrence.cooccurrence(tag_sets(spark, folder), ["src"], "id", "items", min_count=4, min_share=0.0)
    enough = F.col("n_both") * 250 >= F.col("n_baskets")  # c >= ceil(0.004 N)
    strong = F.col("n_both") * F.col("n_baskets") >= 3 * F.col("n_a") * F.col("n_b")
    return scored.filter(enough & strong).select("src", "item_a", "item_b")


def _distinctive(spark: SparkSession, folder: str) -> DataFrame:
    newest = current_rows(read(spark, folder, "github_repos").select("name", "collected_at", "row_id", "description"), "description")
    texts = newest.select("name", F.lit("github_repos").alias("src"), F.col("row_id").alias("id"), "description")
    words = distinctive.text_terms(texts, ["name", "src"], "description").drop("name")
    stacks = read(spark, folder, "repos").select(F.lit("repos").alias("src"), F.col("repo_id").alias("id"), folded_set(F.col("tech_stack")).alias("items"))
    return distinctive.score_terms(words.unionByName(distinctive.set_terms(stacks, ["src"], "items")), ["src"])


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = _distinctive(spark, folder)
    return scored.select("src", "id", "term", "tf", "df", "cf", (F.round("llr", 4) + F.lit(0.0)).alias("llr"), F.round("tfidf", 4).alias("tfidf"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    share = F.when(F.col("src") == "repos", 0.7).otherwise(1.25)
    return distinctive.distinctive_terms(_distinctive(spark, folder), share).select("src", "id", "term")


def _current_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of the readmes and descriptions of current rows; id is 2 * row_id, + 1 for a description."""
    raw = read(spark, folder, "github_repos")
    ids = current_rows(raw.select("name", "collected_at", "row_id")).select("row_id")
    rows = semi_by_ids(raw.select("row_id", "readme", "description"), ids, "row_id")
    both = F.array(F.struct((F.col("row_id") * 2).alias("id"), F.col("readme").alias("text")), F.struct((F.col("row_id") * 2 + 1).alias("id"), F.col("description").alias("text")))
    return rows.select(F.inline(both)).filter(F.col("text").isNotNull())


def _field(column):
    return F.when(column % 2 == 0, "readme").otherwise("description")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    links, members = neardup.near_duplicates(_current_texts(spark, folder), Fraction(1, 2), width=3, least=6)
    # readmes and descriptions meet only if a readme equals a description or nearly so
    found = pairs.expand(links, members, []).filter(F.col("id_a") % 2 == F.col("id_b") % 2)
    return found.select(_field(F.col("id_a")).alias("field"), F.floor(F.col("id_a") / 2).alias("row_id_a"), F.floor(F.col("id_b") / 2).alias("row_id_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The stricter default: five words, similarity 0.8; a row per text with its class and links."""
    links, members = neardup.near_duplicates(_current_texts(spark, folder))
    of_class = pairs.class_links(cut(links), members, [])
    return of_class.select(_field(F.col("id")).alias("field"), F.floor(F.col("id") / 2).alias("row_id"), F.floor(F.col("class_id") / 2).alias("class_id"), "n_copies", "n_links")


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_markup(read(spark, folder, "github_repos").select(F.col("row_id").alias("id"), F.col("readme").alias("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder).select(F.col("id").alias("row_id"), F.explode("elements").alias("element"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder).select(F.col("id").alias("row_id"), F.col("clean").alias("text"))


def _field_values(spark: SparkSession, folder: str) -> DataFrame:
    newest = current_rows(read(spark, folder, "github_repos").select("name", "collected_at", "row_id", "topics", "language"), "topics", "language")
    blank = F.array().cast("array<string>")
    parts = []
    for field, values in (("topics", F.coalesce("topics", blank)), ("language", F.array("language"))):
        raw = F.filter(F.transform(values, folded), lambda x: x.isNotNull() & (x != ""))
        rows = newest.select(F.lit(field).alias("field"), F.col("row_id").alias("id"), raw.alias("raw"))
        rows = rows.select("field", "id", F.size("raw").alias("size"), "raw", F.posexplode(F.array_distinct("raw")).alias("at", "value"))
        times = F.when(F.size(F.array_distinct("raw")) == F.col("size"), F.lit(1)).otherwise(F.size(F.filter("raw", lambda x: x == F.col("value"))))
        parts.append(rows.select("field", "id", "value", times.cast("bigint").alias("times"), (F.col("at") == 0).alias("first")))
    return parts[0].unionByName(parts[1])


def p5_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.frequencies(_field_values(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_frequencies(spark, folder).filter(F.col("mark") != "").select("field", "value", "mark")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    links, members = setjoin.similar_sets(tag_sets(spark, folder), ["src"], "items")
    return pairs.expand(links, members, ["src"])


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    links, members = setjoin.similar_sets(tag_sets(spark, folder), ["src"], "items")
    return pairs.class_links(cut(links), members, ["src"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    topics = read(spark, folder, "github_repos").select(F.lit("github_repos").alias("src"), F.col("row_id").alias("id"), F.explode(F.array_distinct("topics")).alias("value"))
    stacks = read(spark, folder, "repos").select(F.lit("repos").alias("src"), F.col("repo_id").alias("id"), F.explode(F.array_distinct("tech_stack")).alias("value"))
    return canonical.map_values(topics.unionByName(stacks), read(spark, folder, "tech_vocab"), read(spark, folder, "tech_alias"), ["src", "id"])


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    texts = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), packing.token_count(F.col("text")).alias("size"))
    return packing.pack(texts, 1024)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    split = _packed(spark, folder).groupBy("id").agg(F.count(F.lit(1)).alias("pieces")).filter(F.col("pieces") > 1)
    return split.select(F.col("id").alias("doc_id"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The assignment itself, a row per document or piece."""
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def p8_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and pieces of every packed document: nothing is lost or doubled."""
    return _packed(spark, folder).groupBy(F.col("id").alias("doc_id")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "eval_items").select("item_id", "text"))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair_encoding(read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
