"""Dictionary entries in texts."""

import re
import time

from carteggio.operators import discovery


def pairs(spark, docs, entries):
    d, e = spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(entries, "entity long, name string")
    return {(r["entity"], r["id"]) for r in discovery.mentions(d, "id", "content", e, "entity", "name").collect()}


def test_names_with_signs_at_their_ends(spark):
    docs = ["Acme S.p.A.", "acme s.p.a.x", "(Acme) S.p.A. e altri", "la acme s.p.a", "", None, "m rossi, M.Rossi", "m.rossi_2", "x(acme) y", "ACME  spa", "acme spa\n", "pre (acme)"]
    names = ["Acme S.p.A.", " acme ", "M.Rossi", "(acme)", "acme spa", "acme  spa", "...", "", None, "Rossi, m", "a b c d e f g h i j k l m n", "s.p.a."]
    want = set()
    for j, n in enumerate(names):
        n = (n or "").strip(" ").lower()
        for i, t in enumerate(docs):
            if re.search(r"\w", n) and re.search(rf"(?:^|\W){re.escape(n)}(?:$|\W)", (t or "").lower()):
                want.add((j, i))
    got = pairs(spark, list(enumerate(docs)), list(enumerate(names)))
    assert got == want and (2, 6) in got and (3, 8) not in got and (3, 11) in got
    assert pairs(spark, [(1, "acme")], []) == set() == pairs(spark, [], [(1, "acme")])


def test_many_names_with_a_common_first_word(spark):
    """4,000 names that begin with a word of all 4,000 texts: 16 million pairs share it, 4,000 are mentions."""
    names = [(i, f"m. nome{i}") for i in range(4000)]
    docs = [(i, f"Partecipanti: m.altro@x.example\nVisto da M. Nome{i}. " + "testo di contorno " * 20) for i in range(4000)]
    began = time.time()
    assert pairs(spark, docs, names) == {(i, i) for i in range(4000)}
    assert time.time() - began < 20
