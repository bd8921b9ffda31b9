"""Term statistics on long (doc, term) tables: TF-IDF, keywords, ranking. No driver-side vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, doc: str, words: Column) -> DataFrame:
    """(doc, term, tf, first): occurrences and the first position of each term in a document."""
    return docs.select(doc, F.posexplode(words).alias("pos", "term")).groupBy(doc, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))


def vocabulary(counts: DataFrame, doc: str, size: int, examples: int = 10) -> DataFrame:
    """The ``size`` most frequent terms: (term, freq, doc_freq, examples), ties alphabetically.

    Examples are the smallest document ids; each group of documents hands on only that many before they meet.
    """
    part = counts.groupBy("term", F.pmod(F.xxhash64(doc), F.lit(16)).alias("g")).agg(F.sum("tf").alias("freq"), F.count("*").alias("doc_freq"), F.slice(F.array_sort(F.collect_set(doc)), 1, examples).alias("ex"))
    whole = part.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("doc_freq").alias("doc_freq"), F.slice(F.array_sort(F.flatten(F.collect_list("ex"))), 1, examples).alias("examples"))
    return whole.orderBy(F.col("freq").desc(), "term").limit(size)


def tfidf(counts: DataFrame, doc: str, n_docs: DataFrame, size: int | None = None, sublinear: bool = False) -> DataFrame:
    """(doc, term, weight) with smooth idf ``ln((1+n)/(1+df)) + 1`` and unit length per document.

    ``n_docs`` is one row (n). ``size`` keeps the most frequent terms of the corpus, ties alphabetically.
    """
    stats = counts.groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))
    if size:
        stats = stats.orderBy(F.col("freq").desc(), "term").limit(size)
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    weighted = counts.join(stats, "term").crossJoin(F.broadcast(n_docs)).select(doc, "term", (tf * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    norm = weighted.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def bm25(counts: DataFrame, doc: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score): documents with every term of the query; a greater score is better.

    Only the postings of the query's terms leave the first aggregation; lengths come from the same counts.
    """
    length = counts.groupBy(doc).agg(F.sum("tf").alias("len"))
    corpus = length.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hits = counts.where(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").join(length, doc).crossJoin(F.broadcast(corpus))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(doc).agg(F.sum(part).alias("score"), F.count("*").alias("hits")).where(F.col("hits") == len(set(query))).drop("hits")


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a blank."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def positions(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
