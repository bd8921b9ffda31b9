"""Tables written to cut lineage: where they go and when they leave."""

import os

import pytest

from carteggio import session
from carteggio.operators.graph import connected_components


def folder(spark):
    return {x for x in os.listdir(session.shared_dir(spark)) if x.startswith("cut-")}


def test_only_tables_that_a_result_reads_are_left(spark):
    before = folder(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "src long, dst long")
    found = connected_components(edges)
    left = folder(spark) - before
    assert {r["component"] for r in found.collect()} == {0, 100}
    assert left == {f.rsplit("/", 2)[-2] for f in found.inputFiles()}


def test_nested_calls_hand_their_tables_on(spark):
    @session.tidy
    def inner():
        session.cut(spark.range(3))
        return session.cut(spark.range(5))[0]

    @session.tidy
    def outer():
        return inner().count()

    before = folder(spark)
    assert inner().count() == 5 and len(folder(spark) - before) == 1
    before = folder(spark)
    assert outer() == 5 and folder(spark) == before


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())
