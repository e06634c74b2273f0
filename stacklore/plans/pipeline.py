"""The whole run over a file of collected records: clean, mine, classify, cluster, count, export.

``python -m stacklore.plans.pipeline --raw repos.json --out folder``
"""

from __future__ import annotations

import argparse
import json
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklore.operators import cleaning, explorer, graph, rules, semantic, stats, transactions
from stacklore.session import session
from stacklore.sources import files
from stacklore.storage import cut, tables


def embed(docs: DataFrame, method: str = "tfidf", dims: int = 96, most_terms: int | None = None, weights: str | None = None, vocabulary: str | None = None, length: int = 96, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(vectors(id, vector), scores(id, position, category, score)) of docs(id, text).

    method 'tfidf' weighs terms and takes ``dims`` singular directions; 'bert' runs the
    encoder in ``weights`` and ``vocabulary``. A method that cannot run raises an error;
    nothing is put in its place silently.
    """
    spark = docs.sparkSession
    if method == "tfidf":
        scores = cut(semantic.tfidf_scores(docs, most_terms=most_terms))
        return cut(semantic.svd_embed(semantic.tfidf_weights(docs, most_terms=most_terms), dims, docs)), scores
    if method == "bert":
        from stacklore.functions.vocabulary import category_prompts
        from stacklore.operators.bert import bert_embed

        if not weights or not vocabulary:
            raise ValueError("method 'bert' needs weights and vocabulary")
        vectors = cut(bert_embed(docs, weights, vocabulary, length=length, batch=batch))
        prompts = spark.createDataFrame(category_prompts(), "position int, category string, text string")
        labels = bert_embed(prompts.select(F.col("position").cast("bigint").alias("id"), "text"), weights, vocabulary, length=length, batch=batch)
        labels = labels.join(prompts, F.col("id") == F.col("position")).select("position", "category", "vector")
        return vectors, semantic.vector_scores(vectors, labels)
    if method.startswith("sentence-transformers:"):  # an optional library
        import pyarrow as pa

        from stacklore.functions.vocabulary import category_prompts

        name = method.split(":", 1)[1]

        def encode(batches):
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            for b in batches:
                found = model.encode([t or "" for t in b.column(1).to_pylist()], batch_size=batch, normalize_embeddings=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.tolist(), pa.list_(pa.float32()))], names=["id", "vector"])

        prompts = spark.createDataFrame(category_prompts(), "position int, category string, text string")
        labels = prompts.select(F.col("position").cast("bigint").alias("id"), "text").mapInArrow(encode, "id bigint, vector array<float>")
        vectors = cut(docs.select("id", "text").mapInArrow(encode, "id bigint, vector array<float>"))
        return vectors, semantic.vector_scores(vectors, labels.join(prompts, F.col("id") == F.col("position")).select("position", "category", "vector"))
    raise ValueError(f"unknown method {method!r}")


def run(spark: SparkSession, raw: DataFrame, out: str, order: str = "row_no", min_support: float = 0.012, min_confidence: float = 0.25, min_lift: float = 1.1, max_itemset: int = 3, max_features: int | None = None, svd_dims: int = 96, clusters: int = 13, neighbors: int = 8, description_limit: int | None = None, readme_limit: int | None = None, **model) -> dict:
    """Writes repos, graph_nodes, graph_edges, association_rules, similarities and stats as JSON, and a report; returns the stats.

    Texts are taken whole unless ``description_limit`` or ``readme_limit`` is given.
    """
    with tables():
        return _run(spark, raw, out, order, min_support, min_confidence, min_lift, max_itemset, max_features, svd_dims, clusters, neighbors, description_limit, readme_limit, model)


def _run(spark, raw, out, order, min_support, min_confidence, min_lift, max_itemset, max_features, svd_dims, clusters, neighbors, description_limit, readme_limit, model) -> dict:
    started = time.time()
    ids = F.xxhash64("name")
    repos = cut(cleaning.preprocess(raw, order, description_limit=description_limit, readme_limit=readme_limit).withColumn("id", ids))

    tx = cut(transactions.transactions(repos, "id", "tech_stack"))
    # heaviest edges first, of equals those of the record that came first
    place = repos.select("id", F.col(order).alias("place"))
    edges = cut(transactions.item_pairs(tx).join(place, "id").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.min("place").alias("first_id")))
    nodes = cut(graph.node_table(transactions.item_counts(tx).select("item", "count"), edges))
    algorithm = nodes.select("algorithm").limit(1).collect()
    nodes = nodes.drop("algorithm")
    top = transactions.top_edges(edges)

    sets = cut(rules.frequent_itemsets(tx, min_support, max_itemset))
    mined = cut(rules.association_rules(sets, min_confidence, min_lift, max_itemset))
    summary = rules.itemset_summary(sets, min_support, max_itemset)

    texts = repos.select("id", F.coalesce(F.nullif("combined_text", F.lit("")), "name").alias("text"))
    vectors, scores = embed(texts, dims=svd_dims, most_terms=max_features, **model)
    full = repos.join(semantic.classify(scores), "id").join(semantic.kmeans_clusters(vectors, clusters), "id", "left").join(semantic.pca_projection(vectors), "id", "left")
    full = cut(full)
    near = semantic.knn_cosine(vectors, max(1, min(neighbors, repos.count() - 1)))
    names = full.select(F.col("id").alias("i"), F.col("name").alias("n"))
    near = near.join(names, F.col("id") == F.col("i")).select(F.col("n").alias("name"), "neighbour", F.col("place").alias("neighbour_no"), "score")
    near = near.join(names, F.col("neighbour") == F.col("i")).select("name", F.col("n").alias("neighbour"), "neighbour_no", "score")

    folder = Path(out)
    files.write_json_array(cleaning.export_projection(full), f"{out}/repos.json")
    files.write_json_array(nodes.orderBy(F.desc("pagerank"), F.desc("count"), "id"), f"{out}/graph_nodes.json", 2)
    files.write_json_array(top, f"{out}/graph_edges.json")
    files.write_json_array(rules.association_rules(sets, min_confidence, min_lift, max_itemset), f"{out}/association_rules.json", 2)
    files.write_json_array(explorer.neighbour_lists(near), f"{out}/similarities.json")

    def counted(df: DataFrame, key: str, value: str = "count") -> dict:
        return {str(r[key]): r[value] for r in df.collect()}

    def frequencies(column: str, n: int = 1000) -> dict:
        return counted(stats.top_n_freq(full, column, n, order), "value")

    said = cut(stats.insights(nodes, mined, full))
    tops = nodes.orderBy(F.desc("pagerank"), F.desc("count"), "id").limit(12).select(F.col("id").alias("item"))
    trends: dict[str, dict[str, int]] = {r["item"]: {} for r in tops.collect()}
    for r in stats.trend_counts(full, "tech_stack", "created_year", tops).orderBy("item", "year").collect():
        trends[r["item"]][str(r["year"])] = r["count"]
    totals = {r["field"]: {k: r[k] for k in ("total", "mean", "median", "max")} for r in stats.summary_stats(full, ["stars", "forks"]).collect()}

    def leaders(by: str, n: int) -> list[dict]:
        return [{"tech": r["id"], "score": r[by], "repos": r["count"]} for r in nodes.orderBy(F.desc(by), F.desc("pagerank"), F.desc("count"), "id").limit(n).collect()]

    result = {
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "runtime_seconds": round(time.time() - started, 2),
        **{r["metric"]: r["value"] for r in stats.kpis(full, nodes, top.count(), mined.count()).collect()},
        "embedding_method": model.get("method", "tfidf"),
        "community_algorithm": algorithm[0][0] if algorithm else None,
        "average_bert_confidence": stats.mean_of(full, "bert_confidence").first()["mean"],
        **totals,
        "data_source_distribution": frequencies("data_origin"), "category_distribution": frequencies("bert_category"), "language_distribution": frequencies("language", 25),
        "era_distribution": frequencies("era"), "popularity_distribution": frequencies("popularity"), "license_distribution": frequencies("license", 12), "cluster_distribution": frequencies("cluster_id"),
        "frequent_itemsets": counted(summary, "name", "value"),
        "top_pagerank": leaders("pagerank", 20), "top_authorities": leaders("authority", 15), "top_hubs": leaders("hub", 15),
        "top_repositories": [r.asDict() for r in explorer.top_repositories(full).collect()],
        "trends": trends,
        "insights": [r["text"] for r in said.orderBy("place").collect()],
    }
    (folder / "stats.json").write_text(json.dumps(result, indent=2, ensure_ascii=False), encoding="utf-8")
    files.markdown_report(f"{out}/project_report.md", nodes, mined, said)
    return result


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--raw", required=True, help="JSON array of collected records")
    p.add_argument("--out", required=True, help="local folder for the results")
    for flag, kind, default in (("min-support", float, 0.012), ("min-confidence", float, 0.25), ("min-lift", float, 1.1), ("max-itemset", int, 3), ("max-features", int, None), ("svd-dims", int, 96), ("clusters", int, 13), ("neighbors", int, 8)):
        p.add_argument(f"--{flag}", type=kind, default=default)
    p.add_argument("--description-limit", type=int, help="characters of a cleaned description, default all; the original takes 600")
    p.add_argument("--readme-limit", type=int, help="characters of a cleaned readme, default all; the original takes 1800")
    p.add_argument("--method", default="tfidf", help="tfidf, bert, or sentence-transformers:NAME")
    p.add_argument("--weights")
    p.add_argument("--vocabulary")
    p.add_argument("--length", type=int, default=96)
    p.add_argument("--batch", type=int, default=64)
    given = vars(p.parse_args(args))
    spark = session()
    done = run(spark, files.read_json_array(spark, given.pop("raw")), given.pop("out"), **given)
    print(json.dumps({k: v for k, v in done.items() if k.startswith(("total", "runtime"))}))


if __name__ == "__main__":
    main()
