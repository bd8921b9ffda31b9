"""Problem 5: what is passed over early is only what no rule would take, and long words cost no more than many short ones."""

import re
import time

from carteggio.llm import pii

TEXTS = [
    "Il 17.7.2024 alle 10:58, 74 giorni, 1441 fusti, pratica H9 e KE-1441 del 12/03/2020, 192.0.2.59",
    "AB 12 34 56 C, AB123456C, xAB 12 34 56 C, +AB\n12 34 56 D, qq 12 34 56 A e QQ\t12 34 56 A; npdvrg42r31z350m, 1 85 05 78 006 084 36, 756.1234.5678.97",
    "+39 399 555 1945, (+39) 0999 555678, (02) 1234567, 0999/555678, 0999 555678, 0039 0999 555, 333-555-1234, x333.555.1234, +٣٩ ٣٩٩ ٥٥٥ ١٩٤٥",
    "12345678Z, 12345678-Z, X1234567L, ABCD123, ABCDE123, éABC1234, ½1234567, ABC²1234, 07391186642, DDT 08661110709, 1234567\xa0Marco",
    "Flat 3, 12 High Street, ordine verde, 7 Old Mill\n> Rd, 3 Upper Ave. e 5, rue de la Paix, Lindenstraße 12a, Am Markt 3, 9 Alta Stazione, la strada, street 12",
    "m.corvandel+x@ditta.example, a@b.co@c.de, x [at] ditta.example, rosa(at)y.example, @z.example",
]


def forms(text):
    """(start, kind, end) by trying every digit run, or the letters or sign before it."""
    found = []
    for m in re.finditer(r"\d+", text):
        a = p = m.start()
        while p and a - p < 7 and text[p - 1].isalpha():
            p -= 1
        at = []
        if p == a and a and text[a - 1] in "+(":
            p = a - 1
        elif p == a and a > 2 and text[a - 1] in " \t\n" and text[a - 3 : a - 1].isalpha() and text[a - 3 : a - 1].isupper() and (a == 3 or not text[a - 4].isalnum()):
            at.append(a - 3)
        if not (p and (text[p - 1].isalnum() or text[p - 1] in "_./+-")):
            at.append(p)
        for x in at:
            for kind, rule in (("id", pii.ID), ("phone", pii.PHONE), ("", pii.CODE)):
                if m := rule.match(text, x):
                    found.append((x, kind or pii.shape(m.group()), m.end()))
                    break
    return found


def test_numbers_of_no_form_are_passed_over():
    assert list(pii.starts(TEXTS[0])) == []
    for text in TEXTS + [a[i:] + " " + b for i in range(4) for a in TEXTS for b in TEXTS]:
        assert [(a, *pii.code_kind(text, a)) for a in pii.starts(text) if pii.code_kind(text, a)[0]] == forms(text)


def test_addresses_are_looked_for_beside_their_words_only(monkeypatch):
    lex = pii.Lexicon({"marco"}, {"corvandel"}, [], {})
    got = [pii.occurrences(t, lex) for t in TEXTS]
    assert [TEXTS[4][a:z] for a, z, k in got[4] if k == "address"] == ["Flat 3, 12 High Street", "7 Old Mill\n> Rd", "3 Upper Ave", "5, rue de la Paix", "Lindenstraße 12a", "Am Markt 3"]
    monkeypatch.setattr(pii, "_SIGN", re.compile(""))
    assert [pii.occurrences(t, lex) for t in TEXTS] == got


def test_word_before():
    for text in TEXTS + ["a\tb\x0bc d\r\ne \xa0f", "x" * 200 + " y", "", "  "]:
        for at in range(len(text) + 1):
            z = len(text[:at].rstrip(" \t"))
            assert pii.before(text, at) == re.split(r"[ \n\t\r\xa0]", text[max(0, z - 64) : z])[-1]


def test_long_words_cost_in_proportion():
    text = "x" * 50_000 + " e poi Marco"
    began = time.process_time()
    assert pii._PAIR.findall(text) == [("poi", "Marco")]
    assert time.process_time() - began < 0.5


def test_header_fields_are_read_twice(spark):
    """Once for the user parts, once for display names."""
    rows = [("Marco Rossi <m.rossi@x.it>", "a_b.bianchi@y.it", "al.verdi+tag@z.it; o.neri-blu@k.it", None), (None, None, None, None), ("", "", "", ""),
            ("<m_rossi@x> Marta", "é.rossi@x.it", ".abc@x", "ab.cde.fgh@x.it"), ("x.ab@y Anna <a.annasi9@k.it>", None, "A.B.CDE@x.it", "q.w_erty@u")]
    found = pii.senders(spark.createDataFrame(rows, "sender string, recipients string, cc string, bcc string"))
    assert {tuple(r) for r in found.collect()} == {
        ("bianchi", "surname", 1), ("cde", "given", 1), ("cde", "surname", 1), ("erty", "surname", 1), ("fgh", "surname", 1), ("marco", "given", 1),
        ("neri-blu", "surname", 1), ("rossi", "surname", 2), ("verdi", "surname", 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
