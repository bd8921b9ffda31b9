"""Every registered core query with SQL gives the rows of that SQL."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {n: f for m in entry._modules() if not m.__name__.startswith("carteggio.llm") for n, f in m.QUERIES.items()}
ORACLE = entry.oracle_sql()


def canonical(df):
    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.5f}" if isinstance(x, (float, int)) and not isinstance(x, bool) and math.isfinite(x) else str(x)

    return sorted(tuple(value(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in CORE if n in ORACLE))
def test_against_sql(spark, duck, name):
    got, want = CORE[name](spark, DATA).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def rows(spark, name):
    return CORE[name](spark, DATA).toPandas()


needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_tables
def test_queries_without_sql_are_tested_below():
    assert {n for n in CORE if n not in ORACLE} == {"p1_found", "crc_buckets", "vec_kmeans", "vec_pca2d", "vec_split", "topic_discovery", "instants_by_source"}


@needs_tables
def test_crc_buckets(spark, duck):
    import zlib

    got = rows(spark, "crc_buckets").set_index("doc_id")["bucket"]
    want = {d: -2_000_000 - zlib.crc32(s.encode()) % 1_000_000 for d, s in duck.execute("select doc_id, source from documents where source is not null").fetchall()}
    assert got.to_dict() == want


def vectors(duck):
    import numpy as np

    t = duck.execute("select vec_id, label, embedding from embeddings order by vec_id").fetchall()
    v = np.array([r[2] for r in t], dtype=float)
    return [r[0] for r in t], np.array([r[1] for r in t]), v


def spread(v, labels):
    return sum(((v[labels == k] - v[labels == k].mean(axis=0)) ** 2).sum() for k in set(labels))


@needs_tables
def test_kmeans_halves_what_chance_leaves(spark, duck):
    import numpy as np

    ids, _, v = vectors(duck)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    labels = rows(spark, "vec_kmeans").set_index("vec_id")["cluster"].loc[ids].to_numpy()
    chance = np.random.default_rng(0).integers(0, 10, len(ids))
    assert len(set(labels)) > 1 and spread(v, labels) < spread(v, chance)


@needs_tables
def test_pca_keeps_the_largest_variance(spark, duck):
    import numpy as np

    ids, _, v = vectors(duck)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.linalg.svd(v - v.mean(axis=0), compute_uv=False)
    p = rows(spark, "vec_pca2d").set_index("vec_id").loc[ids]
    assert np.allclose([(p["x"] ** 2).sum(), (p["y"] ** 2).sum()], s[:2] ** 2) and abs(p["x"].mean()) < 1e-9


@needs_tables
def test_split_lowers_the_spread_of_every_group(spark):
    import numpy as np
    from carteggio.operators import diagnostics

    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal([5, 0, 0], 0.3, (8, 3)), rng.normal([0, 5, 0], 0.3, (8, 3)), rng.normal([0, 0, 5], 0.3, (9, 3))])
    df = spark.createDataFrame([(i, 0 if i < 16 else 1, x.tolist()) for i, x in enumerate(v)], "id long, g int, v array<double>")
    got = diagnostics.split_suggestions(df, "id", "g", "v").toPandas().sort_values("id")
    assert got["g"].unique().tolist() == [0] and got["part"].tolist() == [0] * 8 + [1] * 8


@needs_tables
def test_topics(spark):
    t = rows(spark, "topic_discovery")
    n = len(t)
    assert n > 50 and 2 <= t["topic"].nunique() <= max(2, min(40, round((n / 2) ** 0.5)))


@needs_tables
def test_instants_by_source(spark, duck):
    t = rows(spark, "instants_by_source").set_index("source_file_id")
    assert t["n"].to_dict() == dict(duck.execute("select source_file_id, count(*) from emails group by 1").fetchall())
    assert (t["readable"] <= t["n"]).all() and (t["first_us"] <= t["last_us"]).all() and t["readable"].sum() == len(rows(spark, "p1_found"))


def test_sweep_registry_and_small_operators(spark):
    from carteggio.operators import conversations, diagnostics, discovery

    df = spark.createDataFrame([(c, p) for c, n in ((-1, 3), (0, 30), (1, 2)) for p in [0.4] * n], "cluster_id int, probability double")
    best = diagnostics.sweep(lambda p: df.where(f"cluster_id < {p['below']}"), {"below": [0, 1, 2], "other": [0]}, 3)
    assert [b[0]["below"] for b in best] == [2, 1, 0] and best[0][1]["clusters"] == 2
    w = diagnostics.warnings(diagnostics.metrics(df)).first()["warnings"]
    assert w == ["dominant_cluster", "few_clusters", "low_probability"]
    known = spark.createDataFrame([(4, "m", None, 8)], "id long, model_name string, version string, dimension int")
    wanted = spark.createDataFrame([("m", None, 8), ("m", "2", 8)], "model_name string, version string, dimension int")
    assert sorted((r["id"], r["version"] or "") for r in diagnostics.register_models(known, wanted).collect()) == [(4, ""), (5, "2")]
    one = spark.sql("select array('aia', '', 'pratica aia', 'rifiuti', 'rifiuti') as c").select(diagnostics.distinct_phrases(pyspark_col("c")).alias("c")).first()["c"]
    assert one == ["aia", "rifiuti"]
    assert conversations.may_rebuild(0, 5, 0) and conversations.may_rebuild(3, 5, 2, "rebuild-derived") and not conversations.may_rebuild(5, 5, 2)
    for bad in ((3, 5, 2, "safe"), (0, 0, 0, "other")):
        with pytest.raises(ValueError):
            conversations.may_rebuild(*bad)
    assert spark.sql("select 'Area  Nuova!' as x").select(discovery.slug(pyspark_col("x"))).first()[0] == "area_nuova"


def pyspark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_header_linked_messages_follow_nobody_by_subject(spark):
    from carteggio.operators import conversations

    rows_ = [
        (1, "2024-01-01", "a", [], "richiesta dati", ["x"]), (2, "2024-01-02", "b", ["a"], "altro oggetto", ["y"]), (3, "2024-01-03", "c", ["b"], "richiesta dati", ["x"]),
        (4, "2024-01-04", None, [], "richiesta dati", ["x"]), (5, "2024-06-04", None, [], "richiesta dati", ["x"]), (6, "2024-01-04", None, ["gone"], "richiesta", ["x"]),
    ]
    df = spark.createDataFrame(rows_, "id long, at string, own string, cited array<string>, subject_key string, participants array<string>").withColumn("at", pyspark_col("at").cast("timestamp"))
    got = {r["id"]: (r["conversation_id"], r["relation"]) for r in conversations.reconstruct(df).collect()}
    assert got == {1: (1, "isolated"), 2: (1, "headers"), 3: (1, "headers"), 4: (1, "subject_participants_date"), 5: (5, "isolated"), 6: (6, "isolated")}


def test_index_search_and_maintenance(spark, tmp_path):
    from carteggio.operators import discovery, maintenance

    F = __import__("pyspark.sql.functions", fromlist=["x"])
    docs = spark.createDataFrame([(1, "La città è bella"), (2, "citta e cittadini"), (3, "altro"), (4, None)], "id long, text string")
    discovery.build_index(docs, "id", "text", str(tmp_path / "index"), 4)
    assert {r["id"] for r in discovery.search(spark, str(tmp_path / "index"), "id", ["CITTÀ"]).collect()} == {1, 2}
    assert [r["id"] for r in discovery.search(spark, str(tmp_path / "index"), "id", ["citta", "bella"]).collect()] == [1]
    folder = str(tmp_path / "db")
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(f"{folder}/parent.parquet")
    spark.createDataFrame([(10, 1), (11, 9), (12, None)], "id long, parent_id long").write.parquet(f"{folder}/child.parquet")
    keys = [("child", "parent_id", "parent", "id"), ("none", "x", "parent", "id")]
    assert [(r["rows"], r["missing_table"]) for r in maintenance.violations(spark, folder, keys).collect()] == [(1, False), (0, True)]
    assert maintenance.repair(spark, folder, keys, str(tmp_path / "copy")) == {"child.parent_id": 1}
    assert spark.read.parquet(f"{folder}/child.parquet").count() == 2 and spark.read.parquet(str(tmp_path / "copy/child.parquet")).count() == 3
    with pytest.raises(ValueError):
        maintenance.reset(spark, folder, [], confirm=False)
    assert maintenance.reset(spark, folder, [("child", F.col("parent_id") == 1), ("gone", F.lit(True))]) == {"child": 1, "gone": 0}
    assert maintenance.reset_stage(spark, folder, "clustering") == {"clusters": 0, "email_clusters": 0}
    df, v = maintenance.migrate(spark.range(2), {"id": "long", "note": "string"}, 6, 7)
    assert df.columns == ["id", "note"] and v == 7
