"""Nearest texts by TF-IDF against brute force."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from carteggio.operators import nearest as N
from carteggio.plans import analysis

WORD = "[a-zà-öø-ÿ]{3,}"


def brute(docs, every, k=5, size=1000):
    rows, n = {}, 0
    for i, t, *_ in docs:
        if t is not None:
            rows.setdefault(i, []).extend(re.findall(WORD, t.lower()))
            n += 1
    freq = {}
    for words in rows.values():
        for w in words:
            freq[w] = freq.get(w, 0) + 1
    terms = {w: j for j, (w, _) in enumerate(sorted(freq.items(), key=lambda x: (-x[1], x[0]))[:size])}
    ids = sorted(i for i in rows if i is not None)
    tf = np.zeros((len(rows), len(terms)))
    for r, i in enumerate(ids + [i for i in rows if i is None]):
        for w in rows[i]:
            if w in terms:
                tf[r, terms[w]] += 1
    w = tf * (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1)
    w = (w / np.maximum(np.sqrt((w * w).sum(axis=1)), 1e-300)[:, None])[: len(ids)]
    out = set()
    for r, i in enumerate(ids):
        if i % every == 0:
            s = w @ w[r]
            best = sorted((-round(x, 9), j) for x, j in zip(s, ids) if j != i and x > 0)[:k]
            out |= {(i, j, round(-x, 6)) for x, j in best}
    return out


def found(spark, docs, every):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    return {(r["source"], r["target"], round(r["similarity"], 6)) for r in N.nearest(df, "doc_id", "text", WORD, F.col("doc_id") % every == 0, "lang").collect()}


def test_equals_brute_force(spark, monkeypatch):
    """Small blocks and cells; common and rare words, copies, repeated ids, texts without words, nulls everywhere."""
    rng = np.random.default_rng(5)
    words = [f"parola{a}{b}" for a in "abcdefgh" for b in "abcdefghijklmnopqrstuvwxyz"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(1, 25), p=odds / odds.sum())) for _ in range(700)]
    docs = [(i, t, [None, "it", "en", "de"][i % 4]) for i, t in enumerate(texts)]
    docs += [(1000 + i, "Parola uguale per tutti", "it") for i in range(40)] + [(2000, None, "it"), (2001, "12 34", "it"), (2002, "", None), (None, texts[3], "it"), (None, texts[4], "it")]
    docs += [(2004, "unica parolaunica", "it"), (8, texts[9], "fr"), (2005, "la parolaaa parolaaa", "it")]
    want = brute(docs, 4)
    assert found(spark, docs, 4) == want
    for name, value in (("TARGETS", 50), ("ASKED", 16), ("HINTS", 2), ("CELL_TARGETS", 2), ("CELL_ASKED", 3)):
        monkeypatch.setattr(N, name, value)
    assert found(spark, docs, 4) == want
    assert found(spark, [], 4) == set() == found(spark, [(4, "sola", "it"), (5, None, None)], 4)


def test_common_words_make_no_pairs(spark, tmp_path):
    """15,000 texts that share 60 words: pairs by common words would be 700 million rows for the 750 texts searched for."""
    common = " ".join(f"comune{a}{b}" for a in "abcdef" for b in "abcdefghij")
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    docs = [(i, f"{common} gruppo{name(i // 20)}", "it") for i in range(15000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = analysis.similarity_edges(spark, str(tmp_path)).collect()
    assert len(got) == 750 * 5
    assert time.time() - began < 40


def test_no_id_is_left_out(spark, tmp_path):
    """None of the ids is divisible by 20, and every text has its edges."""
    docs = [(i, f"parola{'abcdef'[i % 6]} comune testo{'abcdefgh'[i % 8]}", "it") for i in range(1, 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in analysis.similarity_edges(spark, str(tmp_path)).collect()}
    assert got == brute(docs, 1) and {s for s, *_ in got} == set(range(1, 20))


def test_bounds_that_say_little(spark, monkeypatch):
    """Two directions for all texts of all languages, so that nearly every pair passes the bound; small groups of targets."""
    rng = np.random.default_rng(6)
    words = [f"parola{a}{b}" for a in "abcdefgh" for b in "abcdefghijklmnopqrstuvwxyz"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 12))), ["it", "en", "de"][i % 3]) for i in range(900)] + [(1000 + i, f"sola{'abcdefghij'[i]}", "it") for i in range(10)]
    want = {(s, t): x for s, t, x in brute(docs, 1)}

    def same():
        got = {(s, t): x for s, t, x in found(spark, docs, 1)}
        return got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)  # brute rounds twice

    for name, value in (("BASES", 1), ("DIRECTIONS", 2), ("WIDE", 300)):
        monkeypatch.setattr(N, name, value)
    assert same()
    monkeypatch.setattr(N, "CELL_TARGETS", 1)
    monkeypatch.setattr(N, "TARGETS", 40)
    assert same()
