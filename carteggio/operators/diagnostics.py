"""Measures of a clustering, warnings drawn from them, and what describes a cluster: keywords, labels, typical rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carteggio.operators import terms, vectors
from carteggio.operators.relational import top_k
from carteggio.session import cut, tidy


def metrics(assigned: DataFrame, cluster: str = "cluster_id", probability: str = "probability", small: int = 4, unsure: float = 0.5) -> DataFrame:
    """One row over (cluster, probability); cluster -1 is noise. Sizes are summed up per cluster before they meet."""
    sizes = assigned.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.sum(probability).alias("p"), F.count_if(F.col(probability) < unsure).alias("low"))
    real = F.col("c") != -1
    n = F.when(real, F.col("n"))
    of = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(real).alias("clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise"), F.coalesce(F.max(n), F.lit(0)).alias("max_size"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_size"), F.coalesce(F.percentile(n, 0.5), F.lit(0.0)).alias("median_size"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_size"), F.count_if(n < small).alias("small_clusters"),
        F.coalesce(F.sum(F.when(real, F.col("p"))) / F.sum(n), F.lit(0.0)).alias("mean_probability"), F.coalesce(F.sum(F.when(real, F.col("low"))), F.lit(0)).alias("low_confidence"), F.array_agg(n).alias("_sizes"),
    )
    ratio = lambda a: F.when(F.col("total") > 0, F.col(a) / F.col("total")).otherwise(0.0)
    large = F.size(F.filter("_sizes", lambda x: x > F.col("total") * 0.25)).cast("long")  # at most three clusters hold more than a quarter
    return of.select("*", ratio("noise").alias("noise_ratio"), ratio("max_size").alias("largest_ratio"), large.alias("large_clusters")).drop("_sizes")


def warnings(m: DataFrame, max_noise: float = 0.4, max_largest: float = 0.5, min_clusters: int = 3) -> DataFrame:
    """The row of :func:`metrics` plus ``warnings``, an array of names."""
    found = F.array(
        F.when(F.col("largest_ratio") > max_largest, "dominant_cluster"), F.when(F.col("noise_ratio") > max_noise, "much_noise"), F.when(F.col("clusters") < min_clusters, "few_clusters"),
        F.when((F.col("small_clusters") > F.col("clusters") / 2) & (F.col("clusters") > 0), "many_small_clusters"), F.when(F.col("mean_probability") < 0.5, "low_probability"), F.when(F.col("total") < 20, "small_sample"),
    )
    return m.withColumn("warnings", F.filter(found, lambda x: x.isNotNull()))


@tidy
def group_keywords(docs: DataFrame, doc: str, group: str, words: Column, stop: Iterable[str], k: int = 10, longest: int = 3) -> DataFrame:
    """(group, term, score, rank): the ``k`` phrases with the greatest mean TF-IDF, each group taken as a corpus of its own.

    Stop words go before phrases of one to ``longest`` words are formed; a group's vocabulary are its max(40, 8 k) most
    frequent phrases; counts are damped (1 + ln), documents have unit length. Documents without phrases count as zero.
    """
    clean = F.filter(words, lambda w: ~w.isin(*stop))
    grams = F.concat(*[terms.ngrams(F.col("_w"), n) for n in range(1, longest + 1)])
    rows = docs.select(doc, group, clean.alias("_w"))
    counts, _ = cut(rows.select(group, doc, F.explode(grams).alias("term")).groupBy(group, doc, "term").agg(F.count("*").alias("tf")))
    stats = counts.groupBy(group, "term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))
    kept = top_k(stats, [group], [F.col("freq").desc(), F.col("term")], max(40, 8 * k), "_r").select(group, "term", "df")
    sizes = docs.groupBy(group).agg(F.count("*").alias("size"))
    weights = counts.join(kept.join(sizes, group), [group, "term"]).select(group, doc, "term", "size", ((1 + F.log("tf")) * (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weights.groupBy(group, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    mean = weights.join(norm, [group, doc]).groupBy(group, "term").agg((F.sum(F.col("w") / F.col("norm")) / F.max("size")).alias("score"))
    found, _ = cut(top_k(mean, [group], [F.round("score", 9).desc(), F.col("term")], k))
    return found.select(group, "term", "score", "rank")


def distinct_phrases(c: Column) -> Column:
    """An array without empty phrases and without those that contain or are contained in an earlier one kept."""
    empty = F.array().cast("array<string>")
    return F.aggregate(c, empty, lambda acc, x: F.when((x == "") | F.exists(acc, lambda y: y.contains(x) | x.contains(y)), acc).otherwise(F.concat(acc, F.array(x))))


def labels(keywords: DataFrame, subjects: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """(group, label, confidence): up to three phrases of the first two subjects and first four keywords (term, rank)."""
    first = lambda df, n, name: df.where(F.col("rank") <= n).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias(name))
    none = F.array().cast("array<string>")
    both = sizes.join(first(subjects, 2, "_s"), group, "left").join(first(keywords, 4, "_k"), group, "left")
    found = both.select(group, "size", distinct_phrases(F.concat(F.coalesce("_s", none), F.coalesce("_k", none))).alias("c"))
    label = F.when(F.size("c") > 0, F.array_join(F.slice("c", 1, 3), ", ")).otherwise(F.concat(F.lit("Cluster "), F.col(group).cast("string")))
    return found.select(group, label.alias("label"), F.round(F.least(F.lit(1.0), F.col("size") / 10) * F.when(F.size("c") >= 2, 1.0).otherwise(0.5), 3).alias("confidence"))


@tidy
def split_suggestions(df: DataFrame, key: str, group: str, vector: str, smallest: int = 10, most: float = 0.75, rounds: int = 10) -> DataFrame:
    """(group, key, part): groups of at least ``smallest`` rows and coherence of at most ``most`` divided in two.

    Two-means by Euclidean distance for all groups at once: it starts from the row of the smallest key and the row
    farthest from it; centres are sums per dimension, so no group is collected.
    """
    loose = vectors.coherence(df, group, vector).where((F.col("size") >= smallest) & (F.col("coherence") <= most)).select(group)
    rows, _ = cut(df.select(key, group, vectors.doubles(vector).alias("v")).join(loose, group))
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    first = rows.groupBy(group).agg(F.min_by("v", key).alias("c0"))
    far = rows.join(first, group).groupBy(group).agg(F.max_by("v", F.struct(F.round(gap(F.col("v"), F.col("c0")), 9), -F.col(key))).alias("c1"))
    centres, _ = cut(first.join(far, group))
    for _ in range(rounds):
        part = rows.join(centres, group).select(group, "v", F.when(gap(F.col("v"), F.col("c1")) < gap(F.col("v"), F.col("c0")), 1).otherwise(0).alias("part"))
        means = vectors.centroids(part.withColumn("_g", F.struct(group, "part")), "_g", "v").select(F.col(f"_g.{group}").alias(group), F.col("_g.part").alias("part"), "centroid")
        now = means.groupBy(group).agg(F.max(F.when(F.col("part") == 0, F.col("centroid"))).alias("n0"), F.max(F.when(F.col("part") == 1, F.col("centroid"))).alias("n1"))
        centres, _ = cut(centres.join(now, group).select(group, F.coalesce("n0", "c0").alias("c0"), F.coalesce("n1", "c1").alias("c1")))
    return rows.join(centres, group).select(group, key, F.when(gap(F.col("v"), F.col("c1")) < gap(F.col("v"), F.col("c0")), 1).otherwise(0).alias("part"))


def sweep(run: Callable[[dict], DataFrame], grid: dict[str, list], most: int = 24) -> list[tuple[dict, dict]]:
    """(parameters, metrics) of the first ``most`` combinations of a grid; ``run`` gives (cluster_id, probability)."""
    out = []
    for values in islice(product(*grid.values()), most):
        p = dict(zip(grid, values))
        out.append((p, metrics(run(p)).first().asDict()))
    return sorted(out, key=lambda x: (-x[1]["clusters"], x[1]["largest_ratio"], x[1]["noise_ratio"]))


def register_models(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``known`` (id, model_name, version, dimension) plus the models of ``wanted`` it lacks, numbered on; null versions match."""
    w, k = wanted.select("model_name", "version", "dimension").distinct().alias("w"), known.alias("k")
    same = (F.col("w.model_name") == F.col("k.model_name")) & F.col("w.version").eqNullSafe(F.col("k.version")) & (F.col("w.dimension") == F.col("k.dimension"))
    from pyspark.sql import Window

    fresh = w.join(k, same, "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    n = F.row_number().over(Window.orderBy("model_name", F.col("version").asc_nulls_first(), "dimension"))  # as many rows as models
    fresh = fresh.withColumn("_n", n).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).cast("long").alias("id"), "model_name", "version", "dimension")  # one row
    return known.select(F.col("id").cast("long").alias("id"), "model_name", "version", "dimension").unionByName(fresh)


def majority(df: DataFrame, group: str, value: str, confidence: str, unknown: str = "Da definire") -> DataFrame:
    """(group, value, confidence, covered, size): the most frequent value of a group (ties alphabetically) and its mean confidence."""
    per = df.select(group, F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(unknown)).alias("v"), F.col(confidence).alias("c")).groupBy(group, "v").agg(F.count("*").alias("n"), F.avg(F.coalesce("c", F.lit(0.0))).alias("c"))
    sizes = per.groupBy(group).agg(F.sum("n").alias("size"))
    best = top_k(per, [group], [F.col("n").desc(), F.col("v")], 1)
    return best.join(sizes, group).select(group, F.col("v").alias(value), F.round("c", 2).alias("confidence"), F.col("n").alias("covered"), "size")


def topics(docs: DataFrame, doc: str, words: Column, vocabulary: int = 3000, directions: int = 50, seed: int = 42) -> DataFrame:
    """(doc, topic): k-means over the main directions of unit TF-IDF vectors, with max(2, min(40, round(sqrt(n / 2)))) topics."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer

    rows = docs.select(doc, words.alias("w")).where(F.size("w") > 0)
    n = rows.count()
    if n < 2:
        return rows.select(doc, F.lit(0).alias("topic"))
    tf = CountVectorizer(inputCol="w", outputCol="tf", vocabSize=vocabulary).fit(rows)
    tf_rows = tf.transform(rows)
    idf_rows = IDF(inputCol="tf", outputCol="idf").fit(tf_rows).transform(tf_rows)
    unit = Normalizer(inputCol="idf", outputCol="unit").transform(idf_rows).select(doc, "unit")
    k = min(directions, len(tf.vocabulary))
    reduced = PCA(k=k, inputCol="unit", outputCol="features").fit(unit).transform(unit).select(doc, "features")
    model = KMeans(k=min(n, max(2, min(40, round((n / 2) ** 0.5)))), seed=seed, maxIter=20).fit(reduced)
    return model.transform(reduced).select(doc, F.col("prediction").alias("topic"))
