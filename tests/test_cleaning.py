"""Cleaning, contexts and attachments on small texts with known results."""

import io
import zipfile

import pytest

from carteggio.functions import cleaning as C
from carteggio.operators import contexts

MAILS = [
    ("pec_receipt", "ACCETTAZIONE", "Ricevuta di accettazione del gestore di posta certificata", 0),
    ("delivery_notification", "Delivery Status Notification", "Mail delivery subsystem: delivery has failed", 0),
    ("calendar_message", "Invito riunione", "Riunione di Microsoft Teams. Fai clic qui per partecipare", 0),
    ("short_ack", "Re: conferma", "ok grazie", 0),
    ("newsletter", "Le offerte di oggi", "Scopri tutte le offerte selezionate per te.\nUnsubscribe", 0),
    ("attachment_only", "Documento", "", 1),
    ("attachment_only", "Documento", "Ti trasmetto in allegato il documento", 1),
    ("forward_only", "Messaggio inoltrato", "", 0),
    ("low_information", None, None, 0),
    ("operational_email", "Verifica", "La verifica del progetto richiede i dati del registro di ieri.", 0),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(i, *m[1:]) for i, m in enumerate(MAILS)]
    rows += [
        (100, "Re: Subject AIA sent 03_2026 data", "Testo.\n\nCordiali saluti\nMario Rossi", 0),
        (101, "Fwd: [EXTERNAL] Progetto", "Ti inoltro i documenti.\nInizio messaggio inoltrato:\nFrom: old@example.com\nTesto vecchio", 0),
        (102, "x", "Nuovo.\nIl giorno 3 marzo Anna ha scritto:\n> vecchio\ne ancora\nDa: anna\nfine", 0),
        (103, "Subject: AIA data 03_2026", "Your reference\nSent\nCome\nAggiornamento pratica emissioni AIA.\nData 10/06/2024", 0),
        (104, "a &amp; b", "A&nbsp;casa\r\nhttp://x.example/y\n-----\ntel: 049 123\nvia Roma 3, 35100 Padova\nP. IVA 123\nresta [cid:a.png] qui", 0),
        (105, "s", "Da: qualcuno\ntesto\nQuesto messaggio e i suoi allegati sono riservati\nsegue", 0),
    ]
    df = spark.createDataFrame(rows, "id long, subject string, body_plain string, has_attachments int")
    return {r["id"]: r for r in C.clean_text(df).collect()}


def test_message_types(cleaned):
    assert [cleaned[i]["message_type"] for i in range(len(MAILS))] == [m[0] for m in MAILS]
    assert all(cleaned[i]["excluded"] for i in range(len(MAILS)))


def test_subjects_segments_and_noise(cleaned):
    c = cleaned
    assert c[100]["subject_clean"] == "AIA" and c[100]["body_current_message_clean"] == "Testo." and c[100]["signature_text"] == "Cordiali saluti\nMario Rossi"
    assert c[101]["subject_clean"] == "Progetto" and "vecchio" not in c[101]["semantic_text"] and c[101]["technical_text"].startswith("From: old") and c[101]["forwarded_text"] == "Inizio messaggio inoltrato:"
    assert c[102]["body_current_message_clean"] == "Nuovo." and c[102]["quoted_text"].endswith("e ancora") and c[102]["technical_text"] == "Da: anna\nfine"
    assert not any(w in c[103]["semantic_text"].lower() for w in ("your", "come", "data", "sent", "subject", "03_2026", "10/06/2024")) and "emissioni AIA." in c[103]["semantic_text"]
    assert c[104]["subject_clean"] == "a & b" and c[104]["body_current_message_clean"] == "A casa\nresta qui"
    assert c[105]["body_current_message_clean"] == "Da: qualcuno\ntesto" and c[105]["disclaimer_text"].endswith("segue")


def test_contexts(spark):
    long = "I risultati aggiornati della verifica ambientale sono disponibili nella cartella condivisa del progetto insieme ai verbali firmati ieri da tutti i tecnici."
    rows = [
        (1, "Verifica", long, "", "operational_email", ""),
        (2, "Re: Verifica", "va bene così per noi tutti grazie", long, "operational_email", ""),
        (3, "Documento", "vedi allegato", "", "operational_email", "Allegato relazione: VIA_SEVESO.pdf. " + long),
        (4, "Offerte", long, "", "newsletter", ""),
        (5, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, subject string, current string, thread string, message_type string, attachment_summary string")
    df = df.join(contexts.thread_summaries(df, "id", "thread").withColumnRenamed("summary", "thread_summary"), "id")
    got = {r["id"]: r for r in contexts.contexts(df, "id").collect()}
    assert [got[i]["strategy"] for i in range(1, 6)] == ["current_plus_subject", "thread_dominant", "attachment_dominant", "exclude_from_main_clustering", "exclude_from_main_clustering"]
    assert "Parole chiave thread" in got[2]["text"] and "VIA_SEVESO" in got[3]["text"] and got[4]["reason"].endswith("newsletter") and got[5]["text"] == ""


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_attachments():
    read = lambda p, n, m=None: tuple(contexts.read_attachment(p, n, m, 1 << 20).values())[:2]
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Relazione</w:t></w:r><w:r><w:t> tecnica</w:t></w:r></w:p><w:p><w:r><w:t>fine</w:t></w:r></w:p></w:body></w:document>'
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = packed({
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="Dati" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>kg</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c><v>12</v></c></row><row/></sheetData></worksheet>',
    })
    assert read(b"Relazione \xff", "a.TXT") == ("Relazione �", "extracted")
    assert read(b"a,b\nc,d\n", "x.csv") == ("a | b\nc | d", "extracted")
    assert read(b"x", None, "text/plain") == ("x", "extracted") and read(b"x", "a.bin") == (None, "unsupported")
    assert read(packed({"word/document.xml": word}), "r.docx") == ("Relazione tecnica\nfine", "extracted")
    assert read(book, "r.xlsx") == ("Foglio: Dati\nkg | 12", "extracted")
    assert read(b"no zip", "r.docx")[1] == "error" and read(b"%PDF", "r.pdf")[1] in ("dependency_missing", "error")
    assert read(None, "a.txt") == (None, "metadata_only") and read(b"x" * (2 << 20), "a.txt") == (None, "too_large")
