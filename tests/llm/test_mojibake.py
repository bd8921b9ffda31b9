"""Garbled texts: round trips over many readings, sound texts with rare signs left alone."""

import random

import numpy as np
import pytest

from carteggio.llm import mojibake

WORDS = "però già è così più quantità città perché attività über für größer verzögert sich l’exploitant n’est déclarée où être año según informe técnico não relatório à".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS + ["il registro", "va in archivio", "dopo", "contiene"]) for _ in range(14)) + "."


def read_as(text, reading):
    table = mojibake.high(reading)
    return "".join(chr(b) if b < 128 else table[b - 128] for b in text.encode("utf-8"))


def test_restore(spark):
    rng = random.Random(2)
    plain = [sentence(rng) for _ in range(900)]
    rows, want = [], {}
    for i, t in enumerate(plain):
        if i % 20 == 0:
            reading = mojibake.READINGS[(i // 20) % len(mojibake.READINGS)]
            kind = (i // 160) % 4
            if kind == 0:
                rows.append((i, read_as(t, reading)))
            elif kind == 1:
                rows.append((i, read_as(read_as(t, "cp1252"), "cp1252")))
            elif kind == 2:
                rows.append((i, "Tutto bene: è già così.\n" + read_as(t, reading)))
                t = "Tutto bene: è già così.\n" + t
            else:
                rows.append((i, t.encode("cp1252").decode("cp850")))
            want[i] = t
        else:
            rows.append((i, t))
    sound = ["FAÇADE Â L'ÎLE – ŒUVRE, «RÉSUMÉ» © 2024", "│ voce │ kg │\n├──────┼────┤", "§ 5 ± ½ µm 👍🏽 ♻️", "", None, " ", "Davvero?? Sì! Dove? Qui.", "a" * 50_000, "è" * 50_000, "﻿è"]
    rows += [(10_000 + i, t) for i, t in enumerate(sound)]
    rows += [(20_000, "la quantit� è già così"), (20_001, "la quantit?? corretta ?? gi?? qui")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, status string")
    got = {r["doc_id"]: r for r in mojibake.repair(df).collect()}
    assert {i for i, r in got.items() if r["status"] == "lost"} == {20_000, 20_001}
    good = sum(i in got and got[i]["restored"] == t for i, t in want.items())
    assert good >= 0.95 * len(want)
    assert not set(got) - set(want) - {20_000, 20_001}


def test_empty(spark):
    assert mojibake.repair(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_do_not_make_a_garbled_text_normal(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng)) for i in range(600)]
    single = "Però la città è già così più avanti, perché l'attività continua."
    double = "Für die größte Qualität verzögert sich das Geschäft über Österreich."
    want = {}
    for i in range(300):  # each a quarter of all rows
        for start, plain, bad in ((10_000, single, single.encode("cp1252").decode("cp850")), (20_000, double, read_as(double, "cp1252"))):
            rows.append((start + i, bad))
            want[start + i] = plain
    got = {r["doc_id"]: r["restored"] for r in mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("share", [0.005, 0.05, 0.1, 0.3, 0.5])
@pytest.mark.parametrize("how", ["cp850", "utf-8"])
def test_any_rate_of_garbled_texts(spark, share, how):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(2000):
        t = sentence(rng)
        if rng.random() < share:
            want[i] = t
            rows.append((i, read_as(t, "cp1252") if how == "utf-8" else t.encode("cp1252").decode(how)))
        else:
            rows.append((i, t))
    got = {r["doc_id"]: r["restored"] for r in mojibake.repair(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.get(i) == t for i, t in want.items()) >= 0.95 * len(want)
    assert not set(got) - set(want)


def test_collisions_of_the_sketch():
    rng = np.random.default_rng(1)
    seen = np.unique(rng.integers(0, 1 << 42, 300_000).astype(np.uint64))
    pairs = np.zeros(mojibake.ROWS * mojibake.SLOTS, dtype=np.int32)
    for s in mojibake.slots(seen):
        np.add.at(pairs, s, 1)
    corpus = mojibake.Corpus(pairs, np.zeros(mojibake.CHARS, dtype=np.int32), 1)
    unseen = rng.integers(0, 1 << 42, 100_000).astype(np.uint64)
    assert (corpus.documents(seen) >= 1).all() and (corpus.documents(unseen) > 0).mean() < 0.005 and corpus.collisions() < 0.005
