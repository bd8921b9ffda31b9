"""Clusters against brute force."""

import math

import numpy as np

from carteggio.llm import clusters


def brute(rows, least=0.8, smallest=5):
    ids = [i for i, *_ in rows]
    v = np.array([x for *_, x in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, label = v @ v.T >= least, np.arange(len(v))
    while True:
        new = np.where(near, label[None, :], len(v)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    sizes = np.bincount(label, minlength=len(v))
    return {(ids[i], ids[label[i]]) for i in range(len(v)) if sizes[label[i]] >= smallest}


def test_recall_and_dirty_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(3, 60)) if c else 400):
            rows.append((len(rows) * 3 + 1, "a" if c % 2 else "b", ((centre + rng.standard_normal(32) * 0.06) * rng.uniform(0.1, 30)).tolist()))
    rows += [(len(rows) * 3 + 1 + i, "a", rows[0][2]) for i in range(40)]  # repeated vectors
    rows += [(5000 + i, "b", rng.standard_normal(32).tolist()) for i in range(150)]
    bad = [(9001, "a", None), (9002, "a", [0.0] * 32), (9003, "a", [math.nan] + [1.0] * 31), (9004, "a", [1.0] * 16), (9005, None, [1.0] * 32), (9006, "a", [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "id long, model_name string, embedding array<float>, cell string")
    want = set().union(*(brute([r for r in rows if r[1] == m]) for m in "ab"))
    for block in (1 << 24, 1 << 12):  # the last with divided slabs, divided cells and many blocks
        monkeypatch.setattr(clusters, "BLOCK", block)
        members, found = clusters.cluster(df)
        assert {(r["id"], r["cluster_id"]) for r in members.collect()} == want
        shapes = {r["cluster_id"]: r for r in found.collect()}
        assert {c: r["size"] for c, r in shapes.items()} == {c: sum(1 for _, d in want if d == c) for _, c in want}
        assert all(t and all((i, c) in want for i in t) for c, t in ((c, r["typical"]) for c, r in shapes.items()))


def test_empty_and_single(spark):
    kind = "id long, model_name string, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], kind))[0].count() == 0
    assert clusters.cluster(spark.createDataFrame([(i, "m", [1.0, 0.0]) for i in range(5)], kind))[0].count() == 5


def test_equals_brute_force_beside_hot_groups(spark, monkeypatch):
    """Small groups beside hot ones, loose chains and split cells: the clusters of brute force, whatever the grids propose."""
    rng = np.random.default_rng(11)
    hot = np.eye(32)[0]
    rows = [(i + 1, "a", (hot + rng.standard_normal(32) * 0.05).tolist()) for i in range(500)]
    for c in range(12):  # groups of five at the rim of the hot group
        centre = hot + np.eye(32)[c + 1] * 0.95
        rows += [(len(rows) + 1 + i, "a", (centre + rng.standard_normal(32) * 0.06).tolist()) for i in range(5)]
    for _ in range(8):  # chains, each link just above the least cosine
        a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        rows += [(len(rows) + 1 + i, "a", (np.cos(i * 0.64) * a + np.sin(i * 0.64) * b).tolist()) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, model_name string, embedding array<float>")
    exact = [(i, m, np.array(v, dtype=np.float32)) for i, m, v in rows]
    for block in (1 << 24, 1 << 13):  # the last with divided slabs, divided cells and many blocks
        monkeypatch.setattr(clusters, "BLOCK", block)
        members, found = clusters.cluster(df)
        assert {(r["id"], r["cluster_id"]) for r in members.collect()} == brute(exact)
        assert all(r["typical"] for r in found.collect())


def test_links_at_every_level_of_division(spark, monkeypatch):
    """All links of cosine 0.80 to 0.85 and chains of five survive, however finely the rows are divided."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        step = math.acos(rng.uniform(0.8005, 0.85))
        rows += [(len(rows) + 1 + i, "a", (np.cos(i * step) * a + np.sin(i * step) * b).tolist()) for i in range(5)]
    rows += [(len(rows) + 1 + i, "a", x.tolist()) for i, x in enumerate(rng.standard_normal((400, 24)))]
    exact = [(i, m, np.array(v, dtype=np.float32)) for i, m, v in rows]
    df = spark.createDataFrame(rows, "id long, model_name string, embedding array<float>")
    for block, width in ((1 << 24, 0.4), (1 << 12, 0.4), (1 << 14, 0.1)):
        monkeypatch.setattr(clusters, "BLOCK", block)
        monkeypatch.setattr(clusters, "WIDTH", max(width, 2 / 15))
        got = {(r["id"], r["cluster_id"]) for r in clusters.cluster(df)[0].collect()}
        assert got == brute(exact) and len(got) >= 300


def test_far_blocks_never_meet(spark):
    rows = [(i, "m", [1.0, 0.001 * i, 0.0]) for i in range(20)] + [(100 + i, "m", [0.0, 0.001 * i, 1.0]) for i in range(20)]
    sets = clusters.blocked(clusters.gridded(spark.createDataFrame(rows, "id long, model string, vec array<float>")))
    assert sets.select("block").distinct().count() >= 2
    pairs = clusters.near_blocks(sets, 0.8).select("pair", "block").join(sets.select("block", (sets.id >= 100).alias("far")).distinct(), "block")
    assert pairs.groupBy("pair").agg({"far": "max"}).join(pairs.groupBy("pair").agg({"far": "min"}), "pair").where("`max(far)` <> `min(far)`").count() == 0
