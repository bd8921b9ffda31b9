"""Lines that were not newly written."""

import numpy as np

from carteggio.llm import quotes


def kinds(body):
    return "".join((k or "-")[0] for k in quotes.classify(body))


def test_marks():
    assert kinds("Ciao,\ntesto.\n\nCordiali saluti\n\n-- \nAnna Rossi\nUfficio Ambiente\nTel. 0999 555\n\nPrima di stampare, pensa a quanta carta si può\nrisparmiare.\n\nOn Fri, 19 Apr 2019 at 15:37, Bo\n<b@x.example> wrote:\n> Hi\n>\n> text") == "---s-ssss-dd-qqqqq"
    assert kinds("Hi,\r\ntext.\r\n\r\n-----Original Message-----\r\nFrom: A <a@x.example>\r\nSent: 1 May\r\n\r\nHello\r\nRegards") == "---qqq-qq"
    assert kinds("> old\n> older\n\nnew text.\nFrom: north yard, to: south yard\n\nCheers,\nAnna") == "qq----ss"
    assert kinds("Text.\n> 5 mg/l in sample B\nPorti i miei cordiali saluti al collega.\nRegards,\nBo Li\n33 Old Quarry St.") == "---sss"
    assert kinds("La ripresa è il\n26.12.2023.") == "--" and kinds("") == "-" and kinds("\n\n") == "---"
    assert kinds("Citando Ottavia:\n| Salve,\n| ok\n\nNuovo testo.") == "qqq--"
    assert len(quotes.classify("parola " * 100_000)) == 1


def test_inherited_spans(spark):
    old = "Il verbale del sopralluogo è in bozza e va completata la tabella delle portate misurate.\nLa ditta ha cambiato impianto di destino e va corretta l'anagrafica del produttore locale.\nServe ancora la firma sul formulario prima del conferimento dei fanghi di depurazione.\nLa quarta copia non riporta la quantità corretta e il trasportatore è stato avvisato ieri."
    rewrapped = old.replace("\n", " ").replace(" del ", "\ndel ").replace(" e va ", "\ne va ")
    rows = [(1, "<A@x>", None, old, "z"), (2, None, '{"Message-ID": "<b@x>", "References": "< a@X >"}', "Nuova riga scritta adesso per intero.\n\n" + rewrapped, "z"),
            (3, "<c@x>", '{"In-Reply-To": "<missing@x>"}', old, "z"), (4, "<d@x>", '{"From": "cut', None, "z"), (5, "<a@x>", None, old, "z"), (6, None, "", "  \n ", "z")]
    df = spark.createDataFrame(rows, "id long, original_message_id string, raw_headers_json string, body_plain string, kind string")
    found = {(r["id"], r["line_no"]): r["kind"] for r in quotes.lines(df).collect()}
    assert set(i for i, _ in found) == {2} and set(found.values()) == {"quoted"}
    body = rows[1][3].split("\n")
    assert (2, 1) not in found and len(found) >= 0.7 * sum(1 for x in body[1:] if x.strip())
    text = {r["id"]: r for r in quotes.split(df, quotes.lines(df)).collect()}
    assert text[2]["current_text"].startswith("Nuova riga") and "bozza" in text[2]["quoted_thread_text"] and text[1]["current_text"] == old
    assert quotes.lines(df.limit(0)).count() == 0


def test_short_runs_to_their_ends(spark):
    """Unmarked quotations of some 150 letters, rewrapped, are found whole, their short first and last lines included."""
    old = "Prima voce.\nIl verbale del sopralluogo resta in bozza e va completata la tabella delle portate.\nServe la firma sul formulario prima del conferimento dei fanghi di depurazione.\nUltima voce qui."
    quoted = "Prima voce.\nIl verbale del sopralluogo resta in bozza\ne va completata la tabella delle portate. Serve la firma sul\nformulario prima del conferimento\n...\ndei fanghi di depurazione.\nUltima voce qui."
    shuffled = "Serve la firma prima del conferimento dei fanghi di depurazione.\nIl verbale del sopralluogo va completato e resta in bozza la tabella delle portate."
    rows = [(1, "<a@x>", None, old), (2, "<b@x>", '{"References": "<a@x>"}', "Ecco quanto scritto allora, per comodità.\n\n" + quoted + "\n\nOra manca soltanto la data della visita."),
            (3, "<c@x>", '{"References": "<a@x>"}', shuffled), (4, "<d@x>", None, quoted)]
    found = {(r["id"], r["line_no"]) for r in quotes.lines(spark.createDataFrame(rows, "id long, original_message_id string, raw_headers_json string, body_plain string")).collect()}
    assert found == {(2, k) for k in range(3, 10)}


def test_sixty_letters_and_distant_ancestors(spark):
    """An unmarked quotation of 60 letters is found, and so is one of a message three replies up a chain of parents."""
    first = "Das Gutachten zur Halde liegt dem Amt seit gestern vor und wird bald geprüft werden."
    chain = [(1, "<m1@x>", None, first)]
    for i in range(2, 5):
        chain.append((i, f"<m{i}@x>", f'{{"In-Reply-To": "<m{i - 1}@x>"}}', f"Antwort Nummer {i} ohne jedes Zitat darin."))
    chain.append((5, "<m5@x>", '{"In-Reply-To": "<m4@x>"}', "Zur Erinnerung:\n" + first + "\nAlles klar soweit?"))
    short = "Serve ancora la firma sul formulario prima del conferimento di ieri sera."
    assert 60 <= sum(c.isalpha() for c in short) <= 64
    chain += [(6, "<m6@x>", None, "Prima.\n" + short + "\nDopo."), (7, "<m7@x>", '{"References": "<m6@x>"}', "Nuovo testo.\n" + short + "\nAltro testo nuovo.")]
    chain += [(8, "<m8@x>", '{"In-Reply-To": "<m9@x>"}', "uno"), (9, "<m9@x>", '{"In-Reply-To": "<m8@x>"}', "due")]  # a cycle
    df = spark.createDataFrame(chain, "id long, original_message_id string, raw_headers_json string, body_plain string")
    assert {(r["id"], r["line_no"]) for r in quotes.lines(df).collect()} == {(5, 2), (7, 2)}


def test_common_phrases_are_no_quotations(spark):
    """A sentence that replies to different messages repeat is a phrase of the trade; a longer run is a quotation all the same."""
    phrase = "Porti i miei cordiali saluti al collega e gli dica che il registro è pronto."
    rows = []
    for i in range(3):
        rows += [(2 * i + 1, f"<a{i}@x>", None, f"Lettera {i}.\n{phrase}"), (2 * i + 2, f"<b{i}@x>", f'{{"References": "<a{i}@x>"}}', f"Risposta {i} di oggi.\n{phrase}\nFine {i}.")]
    df = spark.createDataFrame(rows, "id long, original_message_id string, raw_headers_json string, body_plain string")
    assert quotes.lines(df).count() == 0
    assert {(r["id"], r["line_no"]) for r in quotes.lines(df.where("id < 3")).collect()} == {(2, 2)}


def test_messages_read_together(spark):
    """Messages of one batch do not mix: without bodies, words or headers, with marks at either end, alone or together."""
    old = "Il verbale del sopralluogo resta in bozza e va completata la tabella delle portate misurate."
    bodies = [old, "> segno\n" + old, old + "\n\n...\n> segno", "...\n" + old + "\n***\n", "\n", "7", "> solo segni\n> e altri", "Nuovo.\n" + old.replace(" e ", "\n...\ne ") + "\nNuovo.\n\nSaluti\nAnna Rossi"]
    rows = [(100, "<a@x>", None, old)]
    for i, b in enumerate(bodies * 2):
        rows.append((i, f"<m{i}@x>" if i % 3 else None, '{"References": "<a@x>"}' if i % 5 else None, b))
    kind = "id long, original_message_id string, raw_headers_json string, body_plain string"
    found = lambda df: {(r["id"], r["line_no"], r["kind"]) for r in quotes.lines(df).collect()}
    together = found(spark.createDataFrame(rows, kind).coalesce(1))
    assert together == found(spark.createDataFrame(rows, kind).repartition(len(rows), "id")) and len(together) > 20
    assert quotes.codes_of(["a", "\n", "a"]).tolist() == [quotes.code("a"), quotes.LINE_END, quotes.code("a")]
    codes, first = quotes.with_lines(quotes.codes_of(["a", "b", "c"]), np.array([1, 1, 1]), np.array([4, 4, 9]))
    assert first.tolist() == [0, 2] and quotes.words_lines(codes).tolist() == [1, 1]
