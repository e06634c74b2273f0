"""Text weights, vectors, classification, clustering, projection and neighbours."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import dictionary_join, numbered
from stacklore.functions.vectors import as_doubles, dot, normalize
from stacklore.functions.vocabulary import category_prompts
from stacklore.storage import cut, drop

#: Label vectors that are sent to the tasks at once.
MOST_LABELS = 10_000
#: Vectors of a block.
BLOCK = 4096
#: Cells of the term matrix that are kept together as arrays.
CELLS = 300_000
#: Numbers that go to every task, and come back from it, at once in a decomposition.
SENT = 1_000_000


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def ngrams(text: Column, stop_words: list[str], most: int = 2) -> Column:
    """Tokens of two or more word characters without stop words, and their runs of up to ``most``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[runs(n) for n in range(2, most + 1)])


def tfidf_weights(docs: DataFrame, most_terms: int | None = None, min_df: int = 2, grams: int = 2, stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, weight) of docs(id, text): the sparse term matrix in long form.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document at length 1. Terms
    in fewer than ``min_df`` documents are left out; if ``most_terms`` is given, those of the
    most occurrences are kept (ties by term). n counts all documents, also those without terms.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    n = max(1, docs.count())
    counts = docs.select("id", F.explode(ngrams(F.col("text"), stop_words, grams)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = cut(counts)
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if most_terms is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(most_terms)
    weighed = dictionary_join(counts, terms, ["term"], ["df"], "df").select("id", "term", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("raw"))
    weighed = cut(weighed)
    length = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return weighed.join(length, "id").select("id", "term", (F.col("raw") / F.col("length")).alias("weight"))


def top_terms(weights: DataFrame, n: int = 5) -> DataFrame:
    """(id, place, term, weight): the ``n`` heaviest terms of each document, ties by term."""
    rows = weights.selectExpr("id", "term", "weight", "row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS place")
    return rows.filter(F.col("place") <= n).select("id", "place", "term", "weight")


def tfidf_scores(docs: DataFrame, prompts: DataFrame | None = None, **options) -> DataFrame:
    """(id, position, category, score): cosine of each document and category prompt, fitted on both.

    docs(id bigint, text); prompts(position, category, prompt), at most MOST_LABELS rows,
    default the built-in categories. Pairs that share no term have score 0.
    """
    spark = docs.sparkSession
    if prompts is None:
        prompts = spark.createDataFrame(category_prompts(), "position int, category string, prompt string")
    if prompts.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} prompts")
    both = docs.select(F.struct(F.lit(None).cast("int").alias("position"), F.col("id").cast("bigint").alias("doc")).alias("id"), "text")
    both = both.unionByName(prompts.select(F.struct("position", F.lit(None).cast("bigint").alias("doc")).alias("id"), F.col("prompt").alias("text")))
    weights = cut(tfidf_weights(both, **options))
    of_label = weights.filter(F.col("id.position").isNotNull()).select(F.col("id.position").alias("position"), "term", F.col("weight").alias("w"))
    of_docs = weights.filter(F.col("id.doc").isNotNull()).select(F.col("id.doc").alias("id"), "term", "weight")
    scores = of_docs.join(of_label, "term").groupBy("id", "position").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    every = docs.select(F.col("id").cast("bigint").alias("id")).join(F.broadcast(prompts.select("position", "category")))  # counted above
    return every.join(scores, ["id", "position"], "left").na.fill(0.0, ["score"])


def vector_scores(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, position, category, score): the product of each vector and label vector.

    vectors(id, vector), labels(position, category, vector), at most MOST_LABELS rows.
    """
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    rows = vectors.select("id", as_doubles(F.col("vector")).alias("v"))
    names = labels.select("position", "category", as_doubles(F.col("vector")).alias("l"))
    return rows.join(F.broadcast(names)).select("id", "position", "category", dot(F.col("v"), F.col("l")).alias("score"))


def classify(scores: DataFrame) -> DataFrame:
    """(id, bert_category, bert_confidence, semantic_score) of scores(id, position, category, score).

    The best score wins, of equals the first position. Confidence is 0.55 plus 0.45 of the lead over
    the second best, the lead cut to [0, 1]; both to 4 places. Without a second one it counts as 0.
    """
    best = F.max(F.struct("score", (-F.col("position")).alias("place"), "category"))
    both = scores.groupBy("id").agg(best.alias("best"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))  # a score per label
    lead = F.greatest(F.least(F.col("best.score") - F.coalesce(F.get("all", F.lit(1)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return both.select("id", F.col("best.category").alias("bert_category"), F.round(0.55 + lead * 0.45, 4).alias("bert_confidence"), F.round("best.score", 4).alias("semantic_score"))


def label_means(vectors: DataFrame) -> DataFrame:
    """(position, category, vector) from vectors(id, vector, label): the mean vector of each label at length 1."""
    rows = vectors.select("label", F.posexplode(as_doubles(F.col("vector"))).alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    means = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
    return means.select(F.col("label").cast("int").alias("position"), F.col("label").cast("string").alias("category"), normalize(F.col("vector")).alias("vector"))


def expected_categories(raw: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """(id, category) of raw(id, code): the categories that labelled records should get; other codes are left out."""
    from stacklore.functions.scalars import mapped
    from stacklore.functions.vocabulary import CATEGORY_CODES

    codes = CATEGORY_CODES if codes is None else codes
    return raw.filter(F.col("code").isin(*codes)).select("id", mapped(F.col("code"), codes).alias("category"))


def label_accuracy(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(accuracy, n) over the ids in both of predicted(id, category) and expected(id, category)."""
    both = predicted.select("id", F.col("category").alias("p")).join(expected.select("id", F.col("category").alias("e")), "id").filter(F.col("e").isNotNull())
    return both.agg(F.avg(F.when(F.col("p") == F.col("e"), 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(expected, predicted, count)."""
    both = predicted.select("id", F.col("category").alias("predicted")).join(expected.select("id", F.col("category").alias("expected")), "id")
    return both.filter(F.col("expected").isNotNull()).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("count"))


def _nearest(k: int):
    """The k best of a block of vectors for each query of a block, k + 1 as the query itself may be among them."""

    def matrix(cells):
        v = cells.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return cells.field("id").to_numpy(zero_copy_only=False), np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    def search(batches):
        for batch in batches:
            for asked, there in zip(batch.column(0), batch.column(1), strict=True):
                (names, q), (ids, v) = matrix(asked.values), matrix(there.values)
                score = q @ v.T
                # round before comparing, so that equal scores fall to the smaller id
                order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, : k + 1]
                best = np.take_along_axis(score, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, order.shape[1])), pa.array(ids[order].ravel()), pa.array(best.ravel())], names=["id", "neighbour", "score"])

    return search


def knn_cosine(vectors: DataFrame, k: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """(id, place, neighbour, score): the ``k`` nearest of vectors(id bigint, vector) by cosine, exact.

    ``queries``(id, vector) are compared with all vectors, default every vector. Both are
    packed into blocks of about BLOCK; every pair of blocks is a row and gives the k best of
    each query there, and those are merged. A row is no neighbour of its own id; scores
    below 0 count as 0, to 5 places; of equal scores the smaller id comes first. Null vectors
    are left out, zero vectors score 0.
    """

    def packed(df: DataFrame) -> tuple[DataFrame, int]:
        rows = cut(df.select(F.col("id").cast("bigint").alias("id"), as_doubles(F.col("vector")).alias("vector")).filter(F.col("vector").isNotNull()))
        n = rows.count()
        blocks = max(1, -(-n // BLOCK), min(8, n // 256))  # small tables in eight parts, to use the cores
        place = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
        return cut(rows.groupBy(place).agg(F.collect_list(F.struct("id", "vector")).alias("cells"))), blocks

    there, blocks = packed(vectors)
    asked = there if queries is None else packed(queries)[0]
    both = asked.select(F.col("cells").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(there, "block")
    spread = both.select("asked", "cells", "block").repartition(blocks * 4, F.xxhash64("block", F.element_at("asked", 1)["id"])).select("asked", "cells")
    near = spread.mapInArrow(_nearest(k), "id bigint, neighbour bigint, score double").filter(F.col("id") != F.col("neighbour"))
    near = near.selectExpr("id", "neighbour", "score", "row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, neighbour) AS place")
    return near.filter(F.col("place") <= k).select("id", "place", "neighbour", F.round(F.greatest("score", F.lit(0.0)), 5).alias("score"))


def _term_blocks(batches):
    """Rows (id, cells of at and weight) in blocks of about CELLS: ids, where each begins, terms, weights."""

    def block(held):
        ids, sizes, at, weight = (np.concatenate([h[i] for h in held]) for i in range(4))
        start = np.cumsum(sizes) - sizes
        return pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip((ids, start, at, weight), _KINDS, strict=True)], names=["id", "start", "at", "weight"])

    held, size = [], 0
    for batch in batches:
        cells = batch.column(1).flatten()
        held.append([batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()), *(cells.field(c).to_numpy() for c in ("at", "weight"))])
        size += len(cells)
        if size >= CELLS:
            yield block(held)
            held, size = [], 0
    if size:
        yield block(held)


_KINDS = (np.int64, np.int64, np.int32, np.float64)


def _cells(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(np.frombuffer(c[i].as_buffer(), k) for c, k in zip(b.columns, _KINDS, strict=True))


def _times(start, at, weight, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x[at] * weight[:, None], start, axis=0)


def _gram(blocks: DataFrame, x: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times ``x``; every task sends its part to the driver."""
    n, k = x.shape
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(x)

    def run(batches):
        x, out = sent.value, np.zeros((k, n))
        for _, start, at, weight in _cells(batches):
            y = np.repeat(_times(start, at, weight, x), np.diff(start, append=len(at)), axis=0)
            for j in range(k):
                out[j] += np.bincount(at, y[:, j] * weight, n)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    parts = blocks.coalesce(context.defaultParallelism).mapInArrow(run, "part binary").toArrow().column("part")
    sent.destroy()
    total = np.zeros(n * k)
    for part in parts:
        total += np.frombuffer(part.as_buffer())
    return np.ascontiguousarray(total.reshape(k, n).T)


def _directions(multiply, width: int, dims: int, basis: np.ndarray, block: int, tolerance: float = 1e-8) -> tuple[np.ndarray, int]:
    """The ``dims`` main directions of a symmetric matrix by block Lanczos with thick restarts: weights of the rows of ``basis``, and how many rows count.

    Ends when every direction's residual is at most ``tolerance`` of the greatest eigenvalue, or the
    basis spans everything. Directions that give nothing new are replaced by random ones.
    """
    random, most = np.random.default_rng(0), len(basis)
    h, m = np.zeros((most, most)), 0
    x = np.linalg.qr(random.normal(size=(width, min(block, width))))[0]
    while True:
        k = x.shape[1]
        basis[m : m + k] = x.T
        m += k
        w = multiply(x)
        along = np.zeros((m, k))
        for _ in range(2):
            again = basis[:m] @ w
            w -= basis[:m].T @ again
            along += again
        h[:m, m - k : m] = along
        h[m - k : m, :m] = along.T
        values, s = np.linalg.eigh((h[:m, :m] + h[:m, :m].T) / 2)
        values, s = values[::-1], s[:, ::-1]
        x, r = np.linalg.qr(w)
        residual = np.linalg.norm(r @ s[m - k :, :dims], axis=0)
        if m >= width or (m >= dims and residual.max() <= tolerance * values[0]):
            return s[:, :dims], m
        if m + k > most and most < width:
            keep = dims + (most - dims) // 3
            for a in range(0, width, 8192):
                basis[:keep, a : a + 8192] = s[:, :keep].T @ basis[:m, a : a + 8192]
            h[:] = 0
            h[range(keep), range(keep)] = values[:keep]
            m = keep
        x = x[:, : min(k, width - m)]
        idle = np.abs(np.diag(r))[: x.shape[1]] <= 1e-12 * values[0]
        if idle.any():
            x[:, idle] = random.normal(size=(width, int(idle.sum())))
            for _ in range(2):
                x = np.linalg.qr(x - basis[:m].T @ (basis[:m] @ x))[0]


def svd_embed(weights: DataFrame, dims: int = 96, docs: DataFrame | None = None) -> DataFrame:
    """(id, vector): rows of the long term matrix(id, term, weight) in ``dims`` directions, at length 1.

    Every id of docs(id) gets a row; without a weighted term it is the zero vector.

    Directions are those of the truncated singular value decomposition; their signs, and the
    order within equal singular values, are arbitrary. The driver holds some numbers per term in
    memory; the basis, two to three times ``dims`` numbers per term, is a temporary file of the driver.
    """
    terms = cut(numbered(weights.select("term").distinct(), "term").withColumnRenamed("number", "at"))
    width = max(1, terms.count())
    cells = F.array_sort(F.collect_list(F.struct("at", "weight")))
    rows = weights.join(terms, "term").groupBy(F.col("id").cast("bigint").alias("id")).agg(cells.alias("cells"))
    rows = cut(rows.select("id", "cells"))
    count = rows.count()
    dims = max(1, min(dims, max(2, min(count, width) - 1), width))
    if not count:
        ids = rows if docs is None else docs
        return ids.select(F.col("id").cast("bigint").alias("id"), F.array_repeat(F.lit(0.0), dims).alias("vector"))

    blocks = cut(rows.mapInArrow(_term_blocks, "id binary, start binary, at binary, weight binary"))
    drop(rows)
    block = max(1, min(16, SENT // width))
    most = min(width, 2 * dims + 4 * block + 16)
    context, slices = rows.sparkSession.sparkContext, []
    with tempfile.TemporaryFile() as file:
        basis = np.memmap(file, np.float64, "w+", shape=(most, width))
        s, m = _directions(lambda x: _gram(blocks, x), width, dims, basis, block)
        step = max(1, 4 * SENT // width)
        for a in range(0, dims, step):
            slices.append(context.broadcast(basis[:m].T @ np.ascontiguousarray(s[:, a : a + step])))
        del basis

    def project(batches):
        held = list(_cells(batches))
        out = [[] for _ in held]
        for v in slices:
            for found, (_, start, at, weight) in zip(out, held, strict=True):
                found.append(_times(start, at, weight, v.value))
            del v._value  # one slice at a time
        for found, (ids, *_) in zip(out, held, strict=True):
            x = np.concatenate(found, axis=1)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), values], names=["id", "vector"])

    found = blocks.mapInArrow(project, "id bigint, vector array<double>")
    if docs is None:
        return found
    zero = F.array_repeat(F.lit(0.0), dims)
    return docs.select(F.col("id").cast("bigint").alias("id")).join(found, "id", "left").select("id", F.coalesce("vector", zero).alias("vector"))


def kmeans_clusters(vectors: DataFrame, k: int = 13, seed: int = 42) -> DataFrame:
    """(id, cluster_id) by k-means; numbers of clusters are arbitrary. One cluster for k or n of 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", array_to_vector(as_doubles(F.col("vector"))).alias("features"))
    k = max(1, min(k, rows.limit(k).count()))
    if k == 1:
        return rows.select("id", F.lit(0).alias("cluster_id"))
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster_id"))


def pca_projection(vectors: DataFrame) -> DataFrame:
    """(id, pca_x, pca_y): the two main directions of the centred vectors, to 6 places; signs are arbitrary.

    Vectors of one member have pca_y 0.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", as_doubles(F.col("vector")).alias("vector"))
    first = rows.limit(1).collect()
    if not first or len(first[0]["vector"]) < 2:
        mean = rows.agg(F.avg(F.get("vector", F.lit(0))).alias("m"))
        return rows.join(F.broadcast(mean)).select("id", F.round(F.get("vector", F.lit(0)) - F.col("m"), 6).alias("pca_x"), F.lit(0.0).alias("pca_y"))
    features = rows.select("id", array_to_vector("vector").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(features).transform(features)
    done = PCA(k=2, inputCol="centred", outputCol="p").fit(centred).transform(centred).select("id", vector_to_array("p").alias("p"))
    return done.select("id", F.round(F.col("p")[0], 6).alias("pca_x"), F.round(F.col("p")[1], 6).alias("pca_y"))
