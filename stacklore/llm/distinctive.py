"""Problem 2: how distinctive a term is of its record.

Every (record, term) is scored by the log-likelihood ratio of the two-by-two table
term / other terms by record / remaining collection. The inverse-frequency score
tf * ln(N / df) stands beside it. ``distinctive_terms`` selects by the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import dictionary_join


def score_terms(counts: DataFrame, by: list[str]) -> DataFrame:
    """Score counts(by, id, term, tf >= 1), one row per record and term.

    Adds df (records with the term), cf (its occurrences), size (terms of the record),
    n_records, n_terms, llr and tfidf. llr is negative where the term is rarer in the
    record than elsewhere. A null term stands for a record without terms: it counts as a
    record and yields no row.
    """
    words = counts.filter(F.col("term").isNotNull())
    words = words.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    total = counts.groupBy(*by).agg(F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).alias("n_terms"), F.sum(F.col("first").cast("bigint")).alias("n_records"))
    scored = dictionary_join(counts, words, [*by, "term"], ["df", "cf"], "df").join(F.broadcast(total), by)  # a row per table
    tfidf = F.col("tf") * F.log(F.col("n_records") / F.col("df"))
    return scored.select(*by, "id", "term", "tf", "size", "df", "cf", "n_records", "n_terms", ratio(F.col("tf")).alias("llr"), tfidf.alias("tfidf"))


def ratio(times: Column) -> Column:
    """The signed log-likelihood ratio of a record that held its term ``times`` times; null where its table cannot be.

    It uses the columns size, cf and n_terms. With these fixed it grows with ``times``: the
    derivative of the unsigned ratio is 2 ln(a d / (b c)), positive exactly where the
    sign is.
    """
    a, row, col, n = (x.cast("double") for x in (times, F.col("size"), F.col("cf"), F.col("n_terms")))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    plain = 2 * (part(a, row * col / n) + part(row - a, row * (n - col) / n) + part(col - a, (n - row) * col / n) + part(n - row - col + a, (n - row) * (n - col) / n))
    possible = (a <= row) & (a <= col) & (a >= row + col - n)
    return F.when(possible, F.when(a * n >= row * col, plain).otherwise(-plain))


def distinctive_terms(scored: DataFrame, share: Column, min_df: int = 2) -> DataFrame:
    """The rows of ``score_terms`` whose score tf * ln(N / df) is at least ``share`` * ln N, with df of ``min_df`` or more.

    The ratio selects. A case holds its term at least share * ln N / ln(N / df) times, and
    the ratio grows with the times, so a row is a case exactly if its ratio reaches that of
    a record of its size with just so many. What lies within rounding of that least ratio is
    settled by the score itself. Terms in every record have score 0 and no case.
    """
    bound = share * F.log("n_records")
    times = bound / F.nullif(F.log(F.col("n_records") / F.col("df")), F.lit(0.0))
    least = ratio(F.greatest(times * (1 - 1e-9), F.lit(0.0)))
    passed = scored.filter((F.col("df") >= min_df) & (F.col("llr") >= least - 1e-6))
    return passed.filter(F.col("tfidf") >= bound - 1e-9)


def text_terms(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """Word counts (by, id, term, tf, size, first) of rows that hold a non-blank text.

    Words are maximal runs of a-z and 0-9 of the lower-cased text. ``first`` marks one
    row per record, so that records can be counted with the words.
    """
    rows = texts.filter(F.btrim(F.col(text), F.lit(" \t\n\r\f\v ")) != "")
    rows = rows.select(*by, "id", F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)).alias("__words"))
    rows = rows.select(*by, "id", F.size("__words").cast("bigint").alias("size"), F.posexplode_outer("__words").alias("__at", "term"))
    rows = rows.groupBy(*by, "id", "term", "size").agg(F.count(F.lit(1)).alias("tf"), F.min("__at").alias("__at"))
    return rows.select(*by, "id", "term", "tf", "size", (F.coalesce("__at", F.lit(0)) == 0).alias("first"))


def set_terms(sets: DataFrame, by: list[str], items: str) -> DataFrame:
    """The same for records that are sets of values; every value counts once."""
    rows = sets.filter(F.size(items) > 0).select(*by, "id", F.size(items).cast("bigint").alias("size"), F.posexplode(items).alias("__at", "term"))
    return rows.select(*by, "id", "term", F.lit(1).cast("bigint").alias("tf"), "size", (F.col("__at") == 0).alias("first"))
