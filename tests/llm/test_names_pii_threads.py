"""Problems 2, 3 and 5 on small archives."""

from datetime import datetime

from carteggio.llm import names, pii, threads

MAIL = "id long, source_file_id long, original_message_id string, message_hash string, subject string, sender string, recipients string, cc string, bcc string, sent_at string, imported_at timestamp, raw_headers_json string, body_plain string, thread_key string, kind string"


def mails(spark, rows):
    """Rows of dicts; what is missing is null."""
    keys = [f.split()[0] for f in MAIL.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], MAIL)


def test_link(spark):
    listed = [(5, "person", "Elisabetta Corvandel"), (9, "person", "Corvandel, Betta"), (11, "person", "Elisabetta Corvnadel"), (12, "person", "Marco Corvandel"), (13, "person", "E. Corvandel"),
              (20, "client", "Tarnesco Trasporti S.r.l."), (21, "supplier", "TRASPORTI TARNESCO SRL"), (22, "client", "Tarnesco Impianti"), (23, "client", "Tarnessco Trasp."), (30, "domain", "Marco Corvandel"), (31, "person", None), (32, "person", "")]
    entities = spark.createDataFrame([(*r, "x") for r in listed], "id long, entity_type string, display_name string, record_type string")
    senders = ['"Elisabetta Corvandel" <e.corvandel@tarnesco.example>', "CORVANDEL Marco <info@x.example>", "Amministrazione <e.corvandel@tarnesco.example>", "<e.corvandel@tarnesco.example>",
               "e.corvandel@tarnesco.example (Betta Corvandel)", "Spett.le Tarnesco Trasporti", "Zeno Quaglione", None, "", "Elisabetta Corvandel - Tarnesco", "Marco Corvandel"]
    emails = mails(spark, [{"id": 100 + i, "sender": s} for i, s in enumerate(senders)])
    got = {(r["record_type"], r["record_id"]): r["entity_id"] for r in names.link(entities, emails).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "entity"} == {9: 5, 11: 5, 13: 5, 21: 20, 23: 20}
    assert {k[1]: v for k, v in got.items() if k[0] == "email"} == {100: 5, 101: 12, 104: 5, 105: 20, 109: 5, 110: 12}
    assert names.link(entities.limit(0), emails.limit(0)).count() == 0


def test_crowded_endings(spark, monkeypatch):
    """Short forms with other initials, and slips in the first letters, meet in crowded blocks too."""
    given = [a + b for a in ("Ar", "Bel", "Cor", "Dul", "Fos", "Gim", "Hov", "Lup", "Mez") for b in ("ando", "issio", "ulfo", "etrio", "onzio", "imbro")]
    listed = [(i + 1, f"{g} Corvandel") for i, g in enumerate(given)]
    listed += [(100 + i, f"{g} {s}") for i, (g, s) in enumerate([("Robert", "Corvandel"), ("Bob", "Corvandel"), ("Giuseppe", "Corvandel"), ("Pino", "Corvandel"), ("Margherita", "Corvandel"), ("Rita", "Covrandel"),
               ("Elizabeth", "Crovandel"), ("Beth", "Corvandel"), ("Ignacio", "Corvandel"), ("I.", "Crovandel"), ("Antonio", "Corvandell"), ("Tonino", "Corvandel")])]
    entities = spark.createDataFrame([(i, "person", n) for i, n in listed], "id long, entity_type string, display_name string")
    for part in (names.PART, 7) if hasattr(names, "PART") else (None,):
        monkeypatch.setattr(names, "PART", part, raising=False)
        got = {r["record_id"]: r["entity_id"] for r in names.link(entities, mails(spark, [])).collect()}
        assert got == {101: 100, 103: 102, 105: 104, 107: 106, 109: 108, 111: 110}


def test_short_forms_are_learned(spark):
    """Michael and Mike stand in no list: they are found because three people use both before their own address."""
    assert not {"michael", "mike", "anna"} & set(names.LONG)
    senders = [f"{g} {s} <m.{s.lower()}@firm.example>" for s in ("Corvandel", "Berlotti", "Zanmiro") for g in ("Michael", "Mike") for _ in range(2)]
    senders += [f"Anna {s} <m.{s.lower()}@firm.example>" for s in ("Corvandel", "Berlotti")]  # a relative at the same address, twice only
    listed = [(1, "Michael Pesgulli"), (2, "Mike Pesgulli"), (3, "Anna Pesgulli"), (4, "Michael Tarnesco"), (5, "Marco Tarnesco")]
    entities = spark.createDataFrame([(i, "person", n) for i, n in listed], "id long, entity_type string, display_name string")
    got = {r["record_id"]: r["entity_id"] for r in names.link(entities, mails(spark, [{"id": 100 + i, "sender": x} for i, x in enumerate(senders)])).collect()}
    assert got == {2: 1}
    few = mails(spark, [{"id": 100 + i, "sender": x} for i, x in enumerate(senders) if "Zanmiro" not in x])
    assert names.link(entities, few).count() == 0


def test_long_names():
    words = names.Words({"maria": 5, "teresa": 5}, frozenset())
    want = ("p", "maria teresa", "della rovere corvandel")
    assert names.parse("Maria Teresa della Rovere Corvandel", False, words) == want
    assert names.parse("DELLA ROVERE CORVANDEL, Maria Teresa", False, words) == want
    assert names.parse("gestione rifiuti della zona nord", False, words) is None


def test_slip_keys_find_what_is_alike(spark):
    words = ["corvandel", "corvnadel", "orvandel", "corvandell", "corvindol", "rossi", "rosi", "ros", "rissa", "ross", "rasso"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    a, b = (df.select(names.F.col("w").alias(c), names.F.explode(names.slip_keys(names.F.col("w"))).alias("key")) for c in ("a", "b"))
    got = {(r["a"], r["b"]) for r in a.join(b, "key").where(names.alike_column(names.F.col("a"), names.F.col("b"))).collect()}
    assert got == {(x, y) for x in words for y in words if x != y and names.alike(x, y)}


def test_near_is_alike():
    words = ["corvandel", "corvnadel", "orvandel", "corvandell", "corvindol", "korvandel", "rossi", "rosi", "ros", "rissa", "rasso", "ross"]
    assert {frozenset(x) for x in names.near(words)} == {frozenset((a, b)) for a in words for b in words if names.alike(a, b)}


def test_lcs():
    assert names.lcs("abcde", "abxde") == 4 and names.lcs("", "a") == 0
    assert names.alike("corvandel", "corvnadel") and names.alike("corvandel", "corvandl") and not names.alike("corvandel", "corvindol") and not names.alike("abc", "abd")


def test_occurrences(spark):
    rows = [{"id": i, "sender": f"{g} {s} <{g[0].lower()}.{s.lower()}@ditta.example>", "body_plain": f"Ciao {g},\ntutto bene. Ho parlato con {g} {s} ieri.\nSaluti\n{g}\nTel. +39 0999 555{1000 + i}"}
            for i, (g, s) in enumerate([(g, s) for g in ("Marco", "Chiara", "Ottavia") for s in ("Corvandel", "Berlotti", "Zanmiro", "Pesgulli")] * 2)]
    body = ("Ciao Tonino,\nscriva a m.corvandel+x@ditta.example oppure info [at] ditta.example. Il codice fiscale è npdvrg42r31z350m.\n"
            "Chiami Marco Corvandel al +39 399 555 1945 in via Tre Ponti, 4/b. Corvandel Trasporti non risponde, DDT 08661110709, partita IVA 07391186642, il 12/03/2020.\nIng. Zanmiro")  # fmt: skip
    rows += [{"id": 500, "subject": "Pratica - Chiara Berlotti", "body_plain": body}, {"id": 501, "subject": "", "body_plain": None}, {"id": 502, "body_plain": "testo " * 60_000}] + [{"id": 600 + i, "body_plain": "Ciao Tonino,\nok.", "sender": None} for i in range(8)]
    emails = mails(spark, rows)
    got = [(r["field"], r["kind"], (body if r["field"] == "body_plain" else "Pratica - Chiara Berlotti")[r["start_pos"] : r["end_pos"]]) for r in pii.find(emails).collect() if r["id"] == 500]
    assert sorted(got) == sorted([
        ("subject", "name", "Chiara Berlotti"), ("body_plain", "name", "Tonino"), ("body_plain", "email", "m.corvandel+x@ditta.example"), ("body_plain", "email", "info [at] ditta.example"),
        ("body_plain", "id_number", "npdvrg42r31z350m"), ("body_plain", "name", "Marco Corvandel"), ("body_plain", "phone", "+39 399 555 1945"), ("body_plain", "address", "via Tre Ponti, 4"), ("body_plain", "name", "Zanmiro"),
    ])
    clean = {r["id"]: r for r in pii.redact(emails).collect()}
    assert clean[500]["subject"] == "Pratica - [NAME]" and "scriva a [EMAIL] oppure [EMAIL]." in clean[500]["body_plain"] and "Corvandel Trasporti" in clean[500]["body_plain"]
    assert clean[501]["body_plain"] is None and clean[502]["body_plain"] == "testo " * 60_000
    assert pii.find(emails.limit(0)).count() == 0


def test_conversations(spark):
    t = datetime(2021, 1, 1)
    base = {"source_file_id": 1, "imported_at": t, "body_plain": "testo", "raw_headers_json": "{}"}
    rows = [
        {"id": 1, "original_message_id": "<A@x>", "message_hash": "a", "sender": "Bo <bo@c.example>", "sent_at": "2020-01-01T10:00:00Z"},
        {"id": 2, "original_message_id": None, "message_hash": "b", "sender": "Studio <STUDIO@own.example>", "sent_at": "2020-01-02T10:00:00Z", "raw_headers_json": '{"message-id": "<b@x>", "REFERENCES": "<a@X>"}'},
        {"id": 3, "original_message_id": "c@x ", "message_hash": "c", "sender": "Bo", "sent_at": "2020-01-01T10:00:00Z", "raw_headers_json": '{"In-Reply-To": "re <B@x>", "From": "<bo@c.example>"}'},
        {"id": 9, "original_message_id": "<a@x>", "message_hash": "a", "sender": "Bo <bo@c.example>", "sent_at": "2020-01-01T10:00:00Z"},  # a copy of 1
        {"id": 10, "message_hash": "d", "original_message_id": "<d@x>", "sender": "studio@own.example", "sent_at": "2020-01-01T10:00:00Z", "thread_key": "t-1"},
        {"id": 11, "message_hash": "e", "original_message_id": "<e@x>", "sender": "bo@c.example", "sent_at": "n/d", "thread_key": "t-1"},
        {"id": 12, "message_hash": "f", "original_message_id": "<f@x>", "sender": "bo@c.example", "sent_at": "2020-01-01T10:00:00Z", "raw_headers_json": '{"References": "<lost@x>"}', "thread_key": "t-2"},
        {"id": 13, "message_hash": "g", "original_message_id": "<g@x>", "sender": "studio@own.example", "sent_at": "2020-01-01T10:00:00Z", "thread_key": "t-2"},
        {"id": 14, "message_hash": "h", "sender": None, "sent_at": None, "thread_key": "none"},
        # a cycle: each cites the other
        {"id": 20, "message_hash": "i", "original_message_id": "<i@x>", "sender": "bo@c.example", "sent_at": "2020-01-01T10:00:00Z", "raw_headers_json": '{"References": "<j@x>"}'},
        {"id": 21, "message_hash": "j", "original_message_id": "<j@x>", "sender": "studio@own.example", "sent_at": "2020-01-01T11:00:00Z", "raw_headers_json": '{"References": "<i@x>"}'},
        {"id": 30, "message_hash": None, "sender": "bo@c.example", "sent_at": "2020-01-01T10:00:00Z", "thread_key": "t-3", "body_plain": " \n"},
        {"id": 31, "message_hash": None, "sender": "studio@own.example", "sent_at": "2020-01-01T10:00:00Z", "thread_key": "t-3", "raw_headers_json": '{"From": "cut'},
    ]
    emails = mails(spark, [{**base, **r} for r in rows])
    sources = spark.createDataFrame([(1, "Europe/Rome")], "id long, zone_name string")
    accounts = spark.createDataFrame([("studio@own.example", "x")], "address string, label string")
    got = {r["id"]: r for r in threads.conversations(emails, sources, accounts).collect()}
    assert {(r["conversation_id"], r["id"], r["turn"], r["speaker"]) for r in got.values() if r["kept"]} == {
        (1, 1, 1, "incoming"), (1, 3, 2, "incoming"), (1, 2, 3, "outgoing"), (20, 20, 1, "incoming"), (20, 21, 2, "outgoing")}
    assert 9 not in got and got[12]["orphan"] and got[20]["backward"] and not got[21]["backward"]
    assert [i for i, r in got.items() if r["cycle"]] == [20]
    ways = {}
    for r in threads.paths(threads.conversations(emails, sources, accounts)).collect():
        ways.setdefault((r["conversation_id"], r["leaf"]), {})[r["step"]] = r["id"]
    assert ways == {(1, 3): {1: 3}, (1, 2): {1: 1, 2: 2}, (20, 21): {1: 20, 2: 21}}
    assert threads.conversations(emails.limit(0), sources, accounts).count() == 0


def test_long_chains_wrong_clocks_and_shared_ids(spark):
    """A chain of 20 with two branches, a parent whose clock is wrong, a cycle of three, and one id that many messages carry."""
    rows = []

    def add(i, own, cites, at, sender="bo@c.example"):
        rows.append({"id": i, "source_file_id": 1, "imported_at": datetime(2021, 1, 1), "body_plain": "testo", "original_message_id": f"<{own}@x>", "message_hash": f"h{i}", "sender": sender,
                     "sent_at": f"2020-01-{at:02d}T10:00:00Z", "raw_headers_json": '{"In-Reply-To": "<%s@x>"}' % cites if cites else "{}"})

    for i in range(1, 21):
        add(i, f"c{i}", f"c{i - 1}" if i > 1 else None, i, "studio@own.example" if i % 2 else "bo@c.example")
    add(30, "d", "c5", 25)  # a second branch
    add(40, "late", None, 20, "studio@own.example")
    add(41, "early", "late", 10)  # answers a message sent later: a wrong clock and no cycle
    for i in range(3):
        add(50 + i, f"r{i}", f"r{(i + 1) % 3}", 3 + i, "studio@own.example" if i else "bo@c.example")
    for i in range(40):
        add(100 + i, "same", None, 5, "studio@own.example")
        add(200 + i, f"s{i}", "same", 6)
    emails = mails(spark, rows)
    sources = spark.createDataFrame([(1, "Europe/Rome")], "id long, zone_name string")
    accounts = spark.createDataFrame([("studio@own.example", "x")], "address string, label string")
    found = threads.conversations(emails, sources, accounts)
    got = {r["id"]: r for r in found.collect()}
    assert {r["conversation_id"] for i, r in got.items() if i >= 100} == {100} and {r["conversation_id"] for i, r in got.items() if i <= 30} == {1}
    assert got[41]["backward"] and not got[41]["cycle"] and sum(got[50 + i]["cycle"] for i in range(3)) >= 1
    assert not any(r["cycle"] for i, r in got.items() if not 50 <= i < 53)
    ways = {}
    for r in threads.paths(found).collect():
        ways.setdefault(r["leaf"], []).append((r["step"], r["id"]))
    assert [i for _, i in sorted(ways[20])] == list(range(1, 21)) and [i for _, i in sorted(ways[30])] == [1, 2, 3, 4, 5, 30]
