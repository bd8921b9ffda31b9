"""Mailboxes as DataFrames: message files, mbox archives, incremental manifests.

Spark lists the files; their content is read in the tasks, piece by piece. Only MIME parsing, which has no built-in
expression, and the framing of archives run in Python. A large mbox is divided into ranges of bytes, each of them a row
of work that reads the messages beginning in its range, so neither a row nor a task holds a whole archive.
Errors stay with their message as a column, so one bad message never stops a run.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import json
import re
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = {
    "path": "string", "seq": "long", "message_id": "string", "message_hash": "string", "subject": "string", "sender": "string", "recipients": "array<string>",
    "cc": "array<string>", "bcc": "array<string>", "sent_at_raw": "string", "sent_at_iso": "string", "headers_json": "string", "body_plain": "string", "body_html": "string",
    "body_text": "string", "attachments": "array<struct<filename:string,mime_type:string,size_bytes:bigint,sha256:string>>", "error": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


#: Bytes of a range of an archive, and of a piece read at once.
RANGE, PIECE = 64 << 20, 1 << 20


def _open(path: str):
    """A file of any file system Arrow knows, local paths included, for reading at any place."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("file:"):
        return open(unquote(path.removeprefix("file:")), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, file_type, file_hash) of the mailboxes below ``folder``; other files are not read.

    ``.eml`` is a message, ``.mbox`` and ``.mbx`` an archive, and so is a file without extension that begins with ``From ``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = F.when(name.endswith(".eml"), "eml").when(name.rlike(r"\.(mbox|mbx)$"), "mbox").when(~name.contains("."), "?")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, kinds = [], []
            for path, kind in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                h = hashlib.sha256()
                with _open(path) as f:
                    piece = f.read(PIECE)
                    kinds.append("mbox" if kind == "?" and piece[:5] == b"From " else None if kind == "?" else kind)
                    while piece and kinds[-1]:
                        h.update(piece)
                        piece = f.read(PIECE)
                hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string()), pa.array(hashes, pa.string())], ["path", "length", "file_type", "file_hash"])

    wanted = files.withColumn("file_type", kind).where("file_type is not null")
    return wanted.mapInArrow(look, "path string, length long, file_type string, file_hash string").where("file_type is not null")


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, file_type, start, end): an archive in ranges of ``size`` bytes, a message file as one range."""
    n = F.when(F.col("file_type") == "mbox", F.greatest(F.ceil(F.col("length") / size), F.lit(1))).otherwise(1)
    rows = files.select("path", "file_type", "length", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    end = F.when(F.col("file_type") == "mbox", F.least((F.col("i").cast("long") + 1) * size, F.col("length"))).otherwise(F.col("length"))
    return rows.select("path", "file_type", (F.col("i").cast("long") * size).alias("start"), end.alias("end"))


_MARK = re.compile(rb"(?:\A|(?<=\n\n)|(?<=\n\r\n))From [^\r\n]*(?:\r?\n|\Z)")


def mbox_messages(f, start: int, end: int, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(place, raw) of the messages of an mbox whose ``From `` line begins in [start, end)."""
    back = min(start, 3)
    f.seek(start - back)
    held, at, open_ = b"", start - back, None  # held begins at byte ``at`` of the file; open_ is where the message begun stands
    more = True
    while more:
        got = f.read(piece)
        more = bool(got)
        held += got
        scan_to = len(held) - (0 if not more else min(len(held), 4096))  # a From line may be cut off at the end of a piece
        for m in _MARK.finditer(held):
            if m.start() >= scan_to and more:
                break
            where = at + m.start()
            if m.start() == 0 and at > 0 or where < start:
                continue  # the start of what was read is no start of a line, or it belongs to the range before
            if open_ is not None and where > open_:
                yield open_, held[open_ - at : m.start()]
                open_ = None
            if where >= end:
                return
            open_ = where
        if open_ is None and at + scan_to >= end and at + scan_to > start:
            return
        keep = max(0, (open_ - at) if open_ is not None else scan_to - 4)
        held, at = held[keep:], at + keep
    if open_ is not None:
        yield open_, held


def unframed(raw: bytes) -> bytes:
    """A message of an mbox without its ``From `` line, with quoted ``From `` lines as they were."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", raw.split(b"\n", 1)[1] if b"\n" in raw else b"").rstrip(b"\r\n")


def decode(part) -> str:
    """Text of a MIME part: declared character set, else UTF-8, bytes that do not fit replaced."""
    payload = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset(), "utf-8"):
        try:
            return payload.decode(charset or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return payload.decode(part.get_content_charset() or "utf-8", "replace") if _known(part.get_content_charset()) else payload.decode("utf-8", "replace")


def _known(charset: str | None) -> bool:
    try:
        "".encode(charset or "utf-8")
    except LookupError:
        return False
    return True


def visible(html: str) -> str:
    """Text of HTML without scripts and styles, one line per text node."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.parts.append(data.strip())

    reader = Reader()
    reader.feed(html)
    return "\n".join(reader.parts)


def parse(raw: bytes) -> dict:
    """One message as a dict of COLUMNS without path and seq."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    text = lambda v: None if v is None else str(email.header.make_header(email.header.decode_header(v)))
    plain, html, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        name, disposition = part.get_filename(), (part.get_content_disposition() or "")
        if disposition == "attachment" or name:
            data = part.get_payload(decode=True) or b""
            files.append({"filename": text(name), "mime_type": part.get_content_type(), "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        elif part.get_content_type() == "text/plain":
            plain.append(decode(part))
        elif part.get_content_type() == "text/html":
            html.append(decode(part))
    body_plain = "\n\n".join(p for p in plain if p.strip()) or None
    body_html = "\n".join(h for h in html if h.strip()) or None
    body = body_plain or (visible(body_html) if body_html else None)
    people = lambda h: [a for _, a in getaddresses([text(v) or "" for v in m.get_all(h, [])]) if a]
    date, iso = m.get("Date"), None
    try:
        iso = parsedate_to_datetime(date).isoformat() if date else None
    except (TypeError, ValueError):
        pass
    keys = [m.get("Message-ID"), date, m.get("From"), m.get("Subject"), body]
    return {
        "message_id": m.get("Message-ID"), "message_hash": hashlib.sha256("\n".join(k or "" for k in keys).encode("utf-8", "replace")).hexdigest(), "subject": text(m.get("Subject")),
        "sender": text(m.get("From")), "recipients": people("To"), "cc": people("Cc"), "bcc": people("Bcc"), "sent_at_raw": date, "sent_at_iso": iso,
        "headers_json": json.dumps({k: str(v) for k, v in m.items()}, ensure_ascii=False, sort_keys=True), "body_plain": body_plain, "body_html": body_html, "body_text": body, "attachments": files, "error": None,
    }


def messages(files: DataFrame, size: int = RANGE) -> DataFrame:
    """One row per message of :func:`scan`'s files (COLUMNS); ``seq`` is the byte at which it begins in its file.

    A message that cannot be read has only its ``error``.
    """
    import pyspark.sql.pandas.types as types
    from pyspark.sql.types import StructType

    arrow = types.to_arrow_schema(StructType.fromDDL(SCHEMA))

    def raws(path: str, kind: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        with _open(path) as f:
            if kind == "mbox":
                yield from ((at, unframed(raw)) for at, raw in mbox_messages(f, start, end))
            else:
                yield 0, f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows = []
                for seq, raw in raws(path, kind, start, end):
                    try:
                        row = parse(raw)
                    except Exception as e:
                        row = dict.fromkeys(COLUMNS) | {"error": f"{type(e).__name__}: {e}"}
                    rows.append(row | {"path": path, "seq": seq})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    spread = ranges(files, size).repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "path", "start")
    return spread.mapInArrow(run, SCHEMA)


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files the manifest (path, file_hash, status) does not know as done with the same content."""
    done = manifest.where("status = 'ok'").select("path", "file_hash")
    return files.join(done, ["path", "file_hash"], "left_anti")


def unseen(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The first of each message hash, by path and place, that is not stored yet; rows with an error are left out."""
    first = Window.partitionBy("message_hash").orderBy("path", "seq")
    fresh = found.where("error is null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(stored.select("message_hash"), "message_hash", "left_anti")


def inventory(found: DataFrame) -> DataFrame:
    """One row: messages, errors, attachments, probable duplicates, first and last year, sent and received by path."""
    year = F.substring("sent_at_iso", 1, 4).cast("int")
    per = found.groupBy(F.coalesce("message_hash", F.lit("")).alias("h")).agg(
        F.count_if(F.col("error").isNull()).alias("n"), F.count_if(F.col("error").isNotNull()).alias("e"), F.sum(F.size("attachments")).alias("files"), F.min(year).alias("lo"), F.max(year).alias("hi"),
        F.count_if(F.col("error").isNull() & F.lower("path").contains("sent")).alias("out"),
    )
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        sum_("n").alias("messages"), sum_(F.greatest(F.col("n") - 1, F.lit(0))).alias("probable_duplicates"), sum_(F.when(F.col("n") > 0, F.col("files"))).alias("attachments"), F.min("lo").alias("first_year"), F.max("hi").alias("last_year"),
        sum_("e").alias("errors"), sum_("out").alias("sent"), sum_(F.col("n") - F.col("out")).alias("received"),
    )


def sampled(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` messages over all files, by path and place: what an import of a sample reads."""
    return found.orderBy("path", "seq").limit(size)


def file_status(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, file_hash, status, messages, errors) for the manifest: ``ok``, ``partial`` if some messages failed, ``error`` if all did."""
    per = found.groupBy("path").agg(F.count("*").alias("messages"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    all_ = files.select("path", "file_hash").join(per, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("messages", "errors")})
    status = F.when(F.col("errors") == 0, "ok").when(F.col("errors") < F.col("messages"), "partial").otherwise("error")
    return all_.select("path", "file_hash", status.alias("status"), "messages", "errors")


def errors(found: DataFrame, module: str = "import") -> DataFrame:
    """(module, kind, message, path, seq): the rows for a table of errors."""
    at = F.instr("error", ": ")
    return found.where("error is not null").select(F.lit(module).alias("module"), F.substr("error", F.lit(1), at - 1).alias("kind"), F.substr("error", at + 2).alias("message"), "path", "seq")


def preview(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (files, fresh): mailboxes found and those whose path no manifest row has."""
    known = manifest.select("path").distinct().withColumn("known", F.lit(True))
    return files.select("path").join(known, "path", "left").agg(F.count("*").alias("files"), F.count_if(F.col("known").isNull()).alias("fresh"))
