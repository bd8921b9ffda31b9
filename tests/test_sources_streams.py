"""Mailbox files, manifests, writers and streams."""

from pyspark.sql import functions as F

from carteggio.sources import mailbox, sinks
from carteggio.streaming import incremental

EML = b"""Message-ID: <m%d@test>
Date: Mon, 10 Jun 2024 10:00:00 +0200
From: =?utf-8?q?Chi=C3=A0ra?= <C@Client.example>
To: Studio <studio@own.example>, b@x.example
Subject: Richiesta
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/plain; charset=latin-1

Citt\xe0 %d
--b
Content-Type: text/csv; name="a.csv"
Content-Disposition: attachment; filename="a.csv"

1,2
--b--
"""


def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.eml").write_bytes(EML % (1, 1))
    (tmp_path / "in/deep/b.EML").write_bytes(EML % (1, 1))
    (tmp_path / "in/c.msf").write_bytes(b"From index")
    (tmp_path / "in/note").write_bytes(b"no mailbox")
    (tmp_path / "in/Inbox").write_bytes(b"From x Mon Jun 10\n" + EML % (2, 2) + b">From the start\n\nFrom y Mon Jun 10\nSubject: html\nContent-Type: text/html\n\n<p>Ciao</p><script>x()</script><b>tu</b>\n")
    (tmp_path / "in/empty.eml").write_bytes(b"")
    return str(tmp_path / "in")


def test_mailbox(spark, tmp_path):
    files = mailbox.scan(spark, folder(tmp_path))
    kinds = {r["path"].rsplit("/", 1)[1]: r["file_type"] for r in files.select("path", "file_type").collect()}
    assert kinds == {"a.eml": "eml", "b.EML": "eml", "Inbox": "mbox"}  # Spark lists no empty files
    found = mailbox.messages(files)
    rows = {(r["path"].rsplit("/", 1)[1], r["seq"]): r for r in found.collect()}
    assert len(rows) == 4
    a = rows["a.eml", 0]
    assert a["body_plain"].strip() == "Città 1" and a["sender"] == "Chiàra <C@Client.example>" and a["recipients"] == ["studio@own.example", "b@x.example"]
    assert a["sent_at_iso"] == "2024-06-10T10:00:00+02:00" and a["attachments"][0]["filename"] == "a.csv" and a["error"] is None
    second = max(k for k in rows if k[0] == "Inbox")
    assert rows[second]["body_text"] == "Ciao\ntu" and rows[second]["message_id"] is None and second[1] > 0
    assert rows["Inbox", 0]["subject"] == "Richiesta"
    stats = mailbox.inventory(found).first()
    assert (stats["messages"], stats["probable_duplicates"], stats["attachments"], stats["first_year"], stats["errors"], stats["received"]) == (4, 1, 3, 2024, 0, 4)
    assert mailbox.unseen(found, found.where("seq > 0").select("message_hash")).count() == 2
    manifest = files.where("path like '%a.eml'").select("path", "file_hash", F.lit("ok").alias("status"))
    assert mailbox.pending(files, manifest).count() == 2
    assert mailbox.preview(files, manifest).first().asDict() == {"files": 3, "fresh": 2}
    assert {r["status"] for r in mailbox.file_status(files, found).collect()} == {"ok"} and mailbox.sampled(found, 2).count() == 2
    broken = found.limit(1).withColumn("error", F.lit("ValueError: no: date"))
    assert mailbox.errors(broken).first().asDict() | {"path": "", "seq": 0} == {"module": "import", "kind": "ValueError", "message": "no: date", "path": "", "seq": 0}
    assert mailbox.file_status(files, broken).where("status = 'error'").count() == 1


def test_archives_are_read_by_ranges(tmp_path):
    texts = [b"Subject: %d\n\n" % i + b"line\nFrom here on\n" * (i * 37 % 50) + b"end" for i in range(60)]
    whole = b"\n\n".join(b"From x%d\n" % i + t for i, t in enumerate(texts)) + b"\n"
    (tmp_path / "a.mbox").write_bytes(whole)
    for size, piece in ((len(whole), 1 << 20), (997, 64), (61, 5000), (5000, 333)):
        got = []
        for start in range(0, len(whole), size):
            with open(tmp_path / "a.mbox", "rb") as f:
                got += mailbox.mbox_messages(f, start, min(start + size, len(whole)), piece)
        assert [mailbox.unframed(raw) for _, raw in got] == texts
        assert all(whole[at:].startswith(b"From x%d\n" % i) for i, (at, _) in enumerate(got))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x"), (2, None, None)], "id long, tags array<string>, name string")
    sinks.csv(df, str(tmp_path / "c"), ["name", "gone", "tags", "id"])
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert back[0].asDict() == {"name": "x", "gone": None, "tags": '["a","b"]', "id": "1"}
    sinks.parquet(df, str(tmp_path / "p"), ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).where("id = 2").count() == 1
    sinks.json(sinks.redacted(df, ["name"]), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("name is not null").count() == 0


def test_stream_once_and_resume(spark, tmp_path):
    schema = "key string, at timestamp"
    src, out = str(tmp_path / "s"), str(tmp_path / "o")

    def add(rows):
        spark.createDataFrame(rows, "key string, at string").select("key", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = incremental.once(incremental.read_folder(spark, src, schema), "key", "at")
        incremental.run_available(stream, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "k")).awaitTermination()

    add([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00")])
    run()
    add([("a", "2024-01-02 00:00:00"), ("c", "2024-01-02 00:00:00")])
    run()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", ["x"]), (2, None, None)], "id long, name string, tags array<string>")
    sinks.single_csv(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbfid,name,tags\r\n1,a|b,")
    sinks.markdown(df, str(tmp_path / "r.md"), "T")
    sinks.html(df, str(tmp_path / "r.html"), "<T>")
    sinks.report({"n": 3}, str(tmp_path / "s.json"), "S")
    assert "a\\|b" in (tmp_path / "r.md").read_text() and "&lt;T&gt;" in (tmp_path / "r.html").read_text() and '"n": 3' in (tmp_path / "s.json").read_text()
    wide = df.select("id", *[F.lit(i).alias(f"c{i}") for i in range(30)])
    sinks.xlsx(wide, str(tmp_path / "r.xlsx"))
    from carteggio.operators.contexts import read_attachment

    text = read_attachment((tmp_path / "r.xlsx").read_bytes(), "r.xlsx", None, 1 << 20)
    assert text["status"] == "extracted" and text["text"].startswith("Foglio: Data\nid | c0")
    assert sinks.study_pack({"rows": df}, str(tmp_path / "pack"), {"other": "rows"}) == {"rows": 2}
    assert spark.read.option("header", "true").csv(str(tmp_path / "pack/other.csv")).count() == 2


def test_decisions_and_dictionary(spark, tmp_path):
    import pytest

    from carteggio.sources.tables import read_csv, read_dictionary

    (tmp_path / "d.csv").write_bytes("\ufeffid,decision\n1,ok\n".encode())
    assert read_csv(spark, str(tmp_path / "d.csv"), ("id", "decision")).first().asDict() == {"id": "1", "decision": "ok"}
    with pytest.raises(ValueError, match="notes"):
        read_csv(spark, str(tmp_path / "d.csv"), ("id", "notes"))
    (tmp_path / "t.json").write_text('{"term": ["AIA", {"name": "Provincia", "aliases": ["Prov."]}], "none": null}')
    assert [tuple(r) for r in read_dictionary(spark, str(tmp_path / "t.json")).collect()] == [("term", "AIA", "AIA"), ("term", "Provincia", "Provincia"), ("term", "Provincia", "Prov.")]


def test_complete_mode_keeps_the_last_batch(spark, tmp_path):
    from carteggio.plans import streams

    for i, at in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 07:00:00")):
        spark.sql(f"select timestamp '{at}' as ts, 'k' as event_type, {i}D as value").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = streams._stream(spark, str(tmp_path), "events", files_per_batch=1)
    rows = streams._drain(spark, incremental.windows(stream, "ts", "event_type", "6 hours"), "complete").collect()
    assert sorted(r["n"] for r in rows) == [1, 2]
