"""Connected components by contraction: hook to the smallest neighbour, jump pointers, shrink, repeat.

Every round hooks each node to its smallest neighbour, flattens the resulting forest by pointer jumping
(``p = p[p]``, so a chain of n hooks takes log n joins) and replaces the edges by the edges between roots.
Edges inside a tree vanish, so the graph shrinks geometrically and no round sees more rows than the one before.
Hooks always point to smaller ids, hence the last root of a component is its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carteggio.session import cut, discard, tidy


@tidy
def jump(pointers: DataFrame, node: str = "node", to: str = "to") -> DataFrame:
    """Flatten a forest of pointers: ``to`` becomes the root. Roots need no row of their own.

    The forest must be free of cycles. Only nodes that point at another node are kept between rounds.
    """
    spark = pointers.sparkSession
    now, path = cut(pointers.select(F.col(node).alias("node"), F.col(to).alias("to")))
    while True:
        step = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left")
        step, new = cut(step.select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        discard(spark, path)
        moved = step.where("moved").limit(1).count()
        now, path = step.select("node", "to"), new
        if not moved:
            return now.select(F.col("node").alias(node), F.col("to").alias(to))


@tidy
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge other than the smallest of its component.

    Nodes that are absent are their own component: isolated nodes, and the smallest node of each component. Null
    ends, loops and repeated edges are ignored; an empty edge list gives an empty result.
    """
    spark = edges.sparkSession
    ends = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b and a is not null and b is not null")
    graph, graph_path = cut(ends.distinct())
    labels = None
    while graph.limit(1).count():
        # each node hooks to its smallest smaller neighbour
        roots = jump(graph.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        roots, roots_path = cut(roots)
        to = lambda c, n: roots.select(F.col("node").alias(c), F.col("to").alias(n))  # noqa: E731, B023
        graph_now = graph.join(to("a", "ra"), "a", "left").join(to("b", "rb"), "b", "left")
        graph_now = graph_now.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        graph, path = cut(graph_now.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(spark, graph_path)
        graph_path = path
        if labels is None:
            labels = roots.select("node", F.col("to").alias("component"))
        else:  # what pointed to a node that was hooked now points to its root; the hooked nodes join
            old = labels.join(to("component", "further"), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
            labels = old.unionByName(roots.select("node", F.col("to").alias("component")))
        labels, _ = cut(labels)
    if labels is None:
        kind = ends.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    return labels
