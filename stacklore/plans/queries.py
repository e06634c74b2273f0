"""The engine's queries over the test tables, one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklore.functions import scalars as S
from stacklore.functions.tables import read
from stacklore.operators import cleaning, explorer, graph, rules, semantic, stats, transactions, validate

#: Steps of PageRank and HITS in the queries.
STEPS = (80, 60)


def joined(*columns: str):
    return [F.array_join(c, ", ").alias(c) for c in columns]


def _stacks(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.transactions(read(spark, folder, "repos").select("repo_id", "tech_stack"), "repo_id", "tech_stack")


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tx = _stacks(spark, folder)
    return transactions.item_counts(tx), transactions.cooccurrence_edges(tx)


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.association_rules(rules.frequent_itemsets(_stacks(spark, folder)))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The heaviest edges of the co-occurrence graph with support and lift."""
    tx = _stacks(spark, folder)
    counts = transactions.item_counts(tx).select("item", "count")
    n = tx.agg(F.count(F.lit(1)).alias("n"))
    edges = transactions.top_edges(transactions.cooccurrence_edges(tx))
    both = edges.join(counts.select(F.col("item").alias("source"), F.col("count").alias("a")), "source").join(counts.select(F.col("item").alias("target"), F.col("count").alias("b")), "target").join(F.broadcast(n))
    return both.select("source", "target", "weight", F.round(F.col("weight") / F.col("n"), 5).alias("support"), F.round(F.col("weight") * F.col("n") / (F.col("a") * F.col("b")), 5).alias("lift"))


def cooccurrence_edges(spark, folder):
    return transactions.cooccurrence_edges(_stacks(spark, folder))


def node_degree(spark, folder):
    return transactions.node_degree(cooccurrence_edges(spark, folder))


def item_support(spark, folder):
    return transactions.item_counts(_stacks(spark, folder)).select("item", "count", F.round("support", 8).alias("support"))


def average_length(spark, folder):
    return transactions.average_length(_stacks(spark, folder)).select(F.round("average_length", 6).alias("average_length"))


def top_edges(spark, folder):
    return transactions.top_edges(cooccurrence_edges(spark, folder), 1500)


def strongest_relations(spark, folder):
    return transactions.strongest_relations(cooccurrence_edges(spark, folder))


def basket_similarity_graph(spark, folder):
    return transactions.basket_similarity_graph(read(spark, folder, "repos"), "repo_id", "tech_stack", "stars")


def repository_influence(spark, folder):
    """PageRank and HITS of the 2,500 first records in their drawn similarity graph; repository_influence_all has all."""
    repos = read(spark, folder, "repos")
    edges = transactions.basket_similarity_graph(repos, "name", "tech_stack", "stars")
    nodes = repos.orderBy(F.desc_nulls_last("stars"), "name").limit(2500).select(F.col("name").alias("id"))
    both = graph.pagerank(nodes, edges, iterations=60).join(graph.hits(nodes, edges, iterations=40), "id")
    return both.select("id", F.round("pagerank", 8).alias("pagerank"), F.round("hub", 7).alias("hub"), F.round("authority", 7).alias("authority"))


def repository_influence_all(spark, folder):
    """PageRank and HITS of all records in the graph of all shared items."""
    out = graph.shared_item_influence(read(spark, folder, "repos"), "name", "tech_stack")
    return out.select("id", F.round("pagerank", 8).alias("pagerank"), F.round("hub", 7).alias("hub"), F.round("authority", 7).alias("authority"))


def clean_documents(spark, folder):
    return read(spark, folder, "documents").select("doc_id", S.clean_text(F.col("text")).alias("clean"))


def clean_readmes(spark, folder):
    return read(spark, folder, "github_repos").select("row_id", S.clean_text(F.col("readme")).alias("clean"))


def normalize_topics(spark, folder):
    return read(spark, folder, "github_repos").select("row_id", S.normalize_topics(F.col("topics")).alias("topics")).select("row_id", *joined("topics"))


def preprocess(spark, folder):
    raw = read(spark, folder, "github_repos").select("row_id", "name", "stars", "forks", "watchers", "open_issues", "language", "topics", "description", "readme", "created_at", "license", "html_url", "data_origin")
    out = cleaning.preprocess(raw, "row_id")
    keep = ["row_id", "name", "stars", "forks", "watchers", "open_issues", "language", "created_year", "era", "popularity", "license", "html_url", "data_origin", "clean_desc", "combined_text"]
    return out.select(*keep, *joined("topics", "tech_stack"))


def dedup_first(spark, folder):
    return cleaning.dedup_first(read(spark, folder, "github_repos").select("row_id", "name", "owner", "collected_at"), "name", "row_id").select("name", "row_id", "owner")


def dedup_last(spark, folder):
    return cleaning.dedup_last(read(spark, folder, "github_repos").select("row_id", "name", "owner"), "name", "row_id")


def upsert(spark, folder):
    """The export with the collected records over it: of equal names the last collected wins."""
    new = read(spark, folder, "github_repos").select("name", F.col("row_id").alias("seq"), "html_url")
    old = read(spark, folder, "repos").select("name", F.col("repo_id").alias("seq"), "html_url")
    return cleaning.upsert(old, new, "name", "seq")


def export_projection(spark, folder):
    out = cleaning.export_projection(read(spark, folder, "repos"))
    return out.select(*[c for c in out.columns if c not in ("topics", "tech_stack")], *joined("topics", "tech_stack"))


def scalar_functions(spark, folder):
    repos = read(spark, folder, "repos")
    return repos.select(
        "repo_id", S.percent(F.col("bert_confidence")).alias("confidence"), S.title_case(F.col("name")).alias("title"), S.escape_html(F.col("description")).alias("escaped"),
        S.clip(F.col("semantic_score"), 0.25, 0.75).alias("clipped"), F.round(S.bubble_radius(F.sqrt(F.col("forks").cast("double")), 1.4, 18.0), 6).alias("radius"),
        S.search_blob("name", "language", "bert_category", "popularity", "topics", "tech_stack", "description").alias("search"),
        S.popularity(F.col("stars")).alias("bucket"), S.era(F.col("created_year")).alias("period"),
    )


def date_parts(spark, folder):
    """Years of dates in odd forms, and counts that may be missing."""
    raw = read(spark, folder, "github_repos")
    return raw.select("row_id", S.parse_year(F.col("created_at")).alias("created"), S.parse_year(F.col("pushed_at"), 0).alias("pushed"), S.first_count(F.col("stars"), F.col("watchers")).alias("stars"))


def freq_tables(spark, folder):
    return stats.distributions(read(spark, folder, "repos"), ["bert_category", "language", "era", "popularity", "data_origin", "cluster_id", "license"])


def top_languages(spark, folder):
    return stats.top_n_freq(read(spark, folder, "repos"), "language", 25, "repo_id")


def top_licenses(spark, folder):
    return stats.top_n_freq(read(spark, folder, "repos"), "license", 12, "repo_id")


def summary_stats(spark, folder):
    return stats.summary_stats(read(spark, folder, "repos"), ["stars", "forks"])


def mean_confidence(spark, folder):
    return stats.mean_of(read(spark, folder, "repos"), "bert_confidence")


def _trends(spark, folder):
    top = read(spark, folder, "graph_nodes").orderBy(F.desc("pagerank"), F.desc("count"), "id").limit(12).select(F.col("id").alias("item"))
    return stats.trend_counts(read(spark, folder, "repos"), "tech_stack", "created_year", top)


def trend_counts(spark, folder):
    return _trends(spark, folder)


def trend_pivot(spark, folder):
    counts = stats.trend_counts(read(spark, folder, "repos"), "tech_stack", "created_year", spark.createDataFrame([("python",), ("rust",), ("data-pipeline",)], "item string"))
    return stats.trend_pivot(counts, ["python", "rust", "data-pipeline"]).withColumnRenamed("data-pipeline", "data_pipeline")


def confidence_histogram(spark, folder):
    return stats.confidence_histogram(read(spark, folder, "repos"), "bert_confidence")


def width_histogram(spark, folder):
    out = stats.width_histogram(read(spark, folder, "repos"), "stars", 20, 0.99)
    return out.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


def describe_exact(spark, folder):
    out = stats.describe_exact(read(spark, folder, "repos"), ["stars", "forks", "bert_confidence"])
    return out.select("field", "count", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def quantile_99(spark, folder):
    return stats.quantile(read(spark, folder, "repos"), "stars", 0.99).select(F.round("quantile", 4).alias("quantile"))


def missing_ratio(spark, folder):
    return stats.missing_ratio(read(spark, folder, "github_repos")).select("field", F.round("ratio", 8).alias("ratio"))


def crosstab(spark, folder):
    return stats.crosstab(read(spark, folder, "repos"), "bert_category", "language")


def community_summary(spark, folder):
    out = stats.group_summary(read(spark, folder, "graph_nodes"), ["community", "tribe"], "count", "pagerank")
    return out.select("community", "tribe", "members", "total", "best")


def community_leader(spark, folder):
    return stats.group_argmax(read(spark, folder, "graph_nodes"), "community", "pagerank", "id")


def most_common_category(spark, folder):
    return stats.mode(read(spark, folder, "repos"), "bert_category")


def quality_metrics(spark, folder):
    return stats.quality_metrics(read(spark, folder, "repos"))


def kpis(spark, folder):
    return stats.kpis(read(spark, folder, "repos"), read(spark, folder, "graph_nodes"), 1500, 238)


def explorer_page(spark, folder):
    page = explorer.explorer_page(read(spark, folder, "repos"), page=2, language="Python", query=" Data")
    return page.select("repo_id", "name", "stars")


def systematic_sample(spark, folder):
    return explorer.systematic_sample(read(spark, folder, "repos").select("repo_id", "pca_x", "pca_y", "cluster_id"), ["repo_id"], 420)


def random_sample(spark, folder):
    return explorer.random_sample(read(spark, folder, "repos"), "repo_id", 10).select("repo_id", "name")


def top_repositories(spark, folder):
    return explorer.top_repositories(read(spark, folder, "repos"))


def recommendations(spark, folder):
    return explorer.recommendations(read(spark, folder, "similarities"), read(spark, folder, "repos"))


def neighbour_lists(spark, folder):
    out = explorer.neighbour_lists(read(spark, folder, "similarities"))
    return out.select("name", F.array_join(F.transform("neighbours", lambda x: x["neighbour"]), ", ").alias("neighbours"))


def value_extent(spark, folder):
    return explorer.extent(read(spark, folder, "repos"), ["pca_x", "pca_y"])


def frequent_itemsets(spark, folder):
    return rules.frequent_itemsets(_stacks(spark, folder)).select(*joined("items"), "size", "count", "n")


def itemset_summary(spark, folder):
    return rules.itemset_summary(rules.frequent_itemsets(_stacks(spark, folder)), 0.012)


def association_rules(spark, folder):
    out = _rules(spark, folder)
    return out.select(*joined("antecedent", "consequent"), *out.columns[2:])


def strict_rules(spark, folder):
    """Few rules pass: the thresholds themselves are tested."""
    found = rules.association_rules(rules.frequent_itemsets(_stacks(spark, folder), 0.004, 4), 0.25, 3.0, 4)
    return found.select(*joined("antecedent", "consequent"), "support_count", "confidence", "lift")


def rule_tiers(spark, folder):
    return stats.freq_table(rules.rule_tiers(_rules(spark, folder), 2), "tier")


def best_rules(spark, folder):
    return rules.best_tier(rules.rule_tiers(_rules(spark, folder), 2)).select(*joined("antecedent", "consequent"), "support_count", "confidence", "lift", "tier")


def recommend_stack(spark, folder):
    found = rules.association_rules(rules.frequent_itemsets(_stacks(spark, folder), 0.006))
    return rules.recommend_stack(found, ["data-pipeline"])


def fpgrowth_itemsets(spark, folder):
    return rules.fpgrowth_itemsets(_stacks(spark, folder)).select(*joined("items"), "size", "count", F.round("support", 8).alias("support"))


def pagerank(spark, folder):
    counts, edges = _graph(spark, folder)
    return graph.pagerank(counts.select(F.col("item").alias("id")), edges, iterations=STEPS[0]).select("id", F.round("pagerank", 8).alias("pagerank"))


def hits(spark, folder):
    counts, edges = _graph(spark, folder)
    out = graph.hits(counts.select(F.col("item").alias("id")), edges, iterations=STEPS[1])
    return out.select("id", F.round("hub", 7).alias("hub"), F.round("authority", 7).alias("authority"))


def label_propagation(spark, folder):
    counts, edges = _graph(spark, folder)
    return graph.label_propagation(counts.select(F.col("item").alias("id")), edges)


def keyword_communities(spark, folder):
    return graph.keyword_communities(transactions.item_counts(_stacks(spark, folder)).select(F.col("item").alias("id")))


def node_table(spark, folder):
    return graph.node_table(*_graph(spark, folder))


def rank_leaders(spark, folder):
    """The 20 nodes of greatest PageRank in the order of the node table, as reports list them."""
    counts, edges = _graph(spark, folder)
    ranked = graph.pagerank(counts.select(F.col("item").alias("id")), edges, iterations=STEPS[0]).select("id", F.round("pagerank", 7).alias("pagerank"))
    best = ranked.join(counts.select(F.col("item").alias("id"), "count"), "id")
    return best.orderBy(F.desc("pagerank"), F.desc("count"), "id").limit(20)


def induced_subgraph(spark, folder):
    return graph.induced_subgraph(read(spark, folder, "graph_nodes"), cooccurrence_edges(spark, folder), 40, 320)


def label_selection(spark, folder):
    return graph.label_selection(read(spark, folder, "graph_nodes")).select("id", "pagerank", "count")


def _vectors(spark, folder):
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn_cosine(spark, folder):
    """The 8 nearest of every vector whose id is divisible by 100, against all vectors."""
    vectors = _vectors(spark, folder).select("id", "vector")
    out = semantic.knn_cosine(vectors, 8, vectors.filter(F.col("id") % 100 == 0))
    return out.select("id", "place", "neighbour", "score")


def knn_all(spark, folder):
    """The same for every vector, as the exported neighbour lists are made."""
    return semantic.knn_cosine(_vectors(spark, folder).select("id", "vector"), 8)


def _classified(spark, folder):
    vectors = _vectors(spark, folder)
    return semantic.classify(semantic.vector_scores(vectors, semantic.label_means(vectors)))


def zero_shot_labels(spark, folder):
    return _classified(spark, folder).select("id", "bert_category", "bert_confidence", "semantic_score")


def label_accuracy(spark, folder):
    expected = _vectors(spark, folder).select("id", F.col("label").cast("string").alias("category"))
    out = semantic.label_accuracy(_classified(spark, folder).select("id", F.col("bert_category").alias("category")), expected)
    return out.select(F.round("accuracy", 6).alias("accuracy"), "n")


def confusion_matrix(spark, folder):
    expected = _vectors(spark, folder).select("id", F.col("label").cast("string").alias("category"))
    return semantic.confusion_matrix(_classified(spark, folder).select("id", F.col("bert_category").alias("category")), expected)


def _tfidf(spark, folder, most_terms: int | None = None):
    docs = read(spark, folder, "repos").select(F.col("repo_id").alias("id"), F.col("description").alias("text"))
    return semantic.tfidf_weights(docs, most_terms, stop_words=["a", "and", "for", "in", "of", "on", "that", "the", "to", "with"])


def _weights(terms):
    return terms.select("id", "term", F.round("weight", 5).alias("weight"))


def _top_terms(terms):
    return semantic.top_terms(terms).select("id", "place", "term", F.round("weight", 5).alias("weight"))


def tfidf_weights(spark, folder):
    """Of the 12,000 most used terms; tfidf_weights_all has all."""
    return _weights(_tfidf(spark, folder, 12_000))


def tfidf_weights_all(spark, folder):
    return _weights(_tfidf(spark, folder))


def tfidf_top_terms(spark, folder):
    """Of the 12,000 most used terms; tfidf_top_terms_all has all."""
    return _top_terms(_tfidf(spark, folder, 12_000))


def tfidf_top_terms_all(spark, folder):
    return _top_terms(_tfidf(spark, folder))


def tfidf_categories(spark, folder):
    docs = read(spark, folder, "repos").select(F.col("repo_id").alias("id"), F.concat_ws(" ", F.col("description"), F.array_join("tech_stack", " ")).alias("text"))
    return semantic.classify(semantic.tfidf_scores(docs))


def svd_embed(spark, folder):
    return semantic.svd_embed(_tfidf(spark, folder), docs=read(spark, folder, "repos").select(F.col("repo_id").alias("id")))


def kmeans_clusters(spark, folder):
    return semantic.kmeans_clusters(_vectors(spark, folder))


def pca_projection(spark, folder):
    return semantic.pca_projection(_vectors(spark, folder))


def validation_checks(spark, folder):
    repos = read(spark, folder, "repos")
    one = repos.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bert_category").alias("k")).first()
    known = {"total_repos": one["n"], "total_categories": one["k"], "embedding_method": "tfidf"}
    edges = transactions.top_edges(cooccurrence_edges(spark, folder))
    return validate.validation_checks(read(spark, folder, "github_repos"), repos, read(spark, folder, "graph_nodes"), edges, _rules(spark, folder), read(spark, folder, "similarities"), known, shown=False, reported=True)


def insights(spark, folder):
    return stats.insights(read(spark, folder, "graph_nodes"), _rules(spark, folder), read(spark, folder, "repos"))


_NOT = {"joined", "flagship", "queries", "read"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k not in _NOT}
