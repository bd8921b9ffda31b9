"""Vector operators on array columns. Sums are taken dimension by dimension, so groups are never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carteggio.operators.relational import top_k


def doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def centroids(df: DataFrame, group: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(group, size, centroid): means per dimension, weighted if a weight is given."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = df.select(group, w.alias("w"), F.posexplode(doubles(vector)).alias("dim", "x"))
    means = parts.groupBy(group, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    # one row per dimension, of which there are as many as the vectors are long
    return means.groupBy(group).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def representatives(df: DataFrame, key: str, group: str, vector: str, k: int = 5) -> DataFrame:
    """(group, key, similarity, rank): the ``k`` rows nearest to the centroid of their group."""
    near = df.select(key, group, doubles(vector).alias("v")).join(centroids(df, group, vector), group).withColumn("similarity", cosine(F.col("v"), F.col("centroid")))
    return top_k(near.select(group, key, "similarity"), [group], [F.round("similarity", 9).desc(), F.col(key)], k)


def coherence(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, size, coherence): mean cosine over all pairs of a group, in linear time.

    With unit vectors the sum over ordered pairs is the squared length of their sum less their number.
    """
    u = df.select(group, unit(doubles(vector)).alias("u"))
    sums = u.select(group, F.posexplode("u").alias("dim", "x")).groupBy(group, "dim").agg(F.sum("x").alias("s"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    sizes = u.groupBy(group).agg(F.count("*").alias("size"), F.count_if(norm(F.col("u")) > 0).alias("m"))
    n = F.col("size")
    return sizes.join(total, group).select(group, "size", F.when(n >= 2, (F.col("q") - F.col("m")) / (n * (n - 1))).alias("coherence"))


def close_groups(df: DataFrame, group: str, vector: str, least: float) -> DataFrame:
    """(left, right, similarity) of groups whose centroids are close. Quadratic in groups, not in rows."""
    c = centroids(df, group, vector)
    a, b = c.select(F.col(group).alias("left"), F.col("centroid").alias("ca")), c.select(F.col(group).alias("right"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("left") < F.col("right")).select("left", "right", cosine(F.col("ca"), F.col("cb")).alias("similarity")).where(F.col("similarity") >= least)


def silhouette(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(key, silhouette) by cosine distance, from group sums instead of pairs."""
    u = df.select(key, group, unit(doubles(vector)).alias("u"))
    sums = u.select(group, F.posexplode("u").alias("dim", "x")).groupBy(group, "dim").agg(F.sum("x").alias("s"))
    sums = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda t: t["s"]).alias("sum"))
    sums = sums.join(u.groupBy(group).agg(F.count("*").alias("n")), group).select(F.col(group).alias("g"), "sum", "n")
    d = u.join(F.broadcast(sums)).withColumn("own", F.col("g") == F.col(group))  # as many rows as groups
    dist = F.when(F.col("own"), F.when(F.col("n") > 1, (F.col("n") - dot(F.col("u"), F.col("sum"))) / (F.col("n") - 1))).otherwise(1 - dot(F.col("u"), F.col("sum")) / F.col("n"))
    both = d.withColumn("d", dist).groupBy(key).agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    return both.select(key, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def few_shot(df: DataFrame, examples: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(key, label, score): best positive cosine less the best negative one (if above 0) per label, the best label.

    ``examples`` (label, positive, example_vector) is what people labelled by hand: a small table.
    """
    pairs = df.select(key, doubles(vector).alias("v")).join(F.broadcast(examples)).withColumn("c", cosine(F.col("v"), doubles("example_vector")))
    per = pairs.groupBy(key, "label").agg(F.max(F.when(F.col("positive"), F.col("c"))).alias("p"), F.max(F.when(~F.col("positive"), F.col("c"))).alias("q"))
    score = F.col("p") - F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(0.0))
    return top_k(per.withColumn("score", score).where(F.col("score") >= least), [key], [F.round("score", 9).desc(), F.col("label")], 1).select(key, "label", "score")


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def separation(df: DataFrame, group: str, vector: str) -> DataFrame:
    """One row (calinski_harabasz, davies_bouldin) by Euclidean distance, from centroids and their pairs only."""
    c = centroids(df, group, vector)
    all_ = centroids(df.withColumn("_all", F.lit(1)), "_all", vector).select(F.col("centroid").alias("mean"), F.col("size").alias("total"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    far = df.select(group, doubles(vector).alias("v")).join(c, group).withColumn("d", gap(F.col("v"), F.col("centroid")))
    spread = far.groupBy(group).agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"))
    g = c.join(spread, group).crossJoin(F.broadcast(all_)).withColumn("b", F.col("size") * F.pow(gap(F.col("centroid"), F.col("mean")), 2))  # one row
    other = g.select(F.col(group).alias("_o"), F.col("centroid").alias("_c"), F.col("s").alias("_s"))
    worst = g.join(other, F.col(group) != F.col("_o")).groupBy(group).agg(F.max((F.col("s") + F.col("_s")) / gap(F.col("centroid"), F.col("_c"))).alias("r"))
    k = F.count("*")
    return g.join(worst, group).agg(((F.sum("b") / (k - 1)) / (F.sum("w") / (F.max("total") - k))).alias("calinski_harabasz"), F.avg("r").alias("davies_bouldin"))
