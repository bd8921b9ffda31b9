"""What stands for a message in search and clustering: summaries of threads, texts of attachments, the context chosen."""

from __future__ import annotations

import csv
import io
import zipfile
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carteggio.functions import cleaning
from carteggio.operators.relational import top_k

# Types that stand for no context, ends of names whose content is read, limits of what is read.
EXCLUDED_TYPES = ("auto_generated", "pec_receipt", "delivery_notification", "calendar_message", "newsletter", "personal_or_commercial_notification", "low_information")
CHARS, ROWS, CELLS, SHEETS, PAGES = 100_000, 100, 20, 10, 50
KIND = pa.struct([("text", pa.string()), ("status", pa.string()), ("error", pa.string())])


def _compact(c: Column) -> Column:
    return cleaning.whitespace_ends(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def thread_summaries(df: DataFrame, key: str, text: str, longest: int = 1500) -> DataFrame:
    """(key, summary): the first three sentences and the eight most frequent words of four letters or more.

    Words rank by count, then by first place. Null and blank texts have the empty summary.
    """
    rows = df.select(key, _compact(F.coalesce(text, F.lit(""))).alias("_c"))
    found = rows.select(key, F.posexplode(F.filter(F.regexp_extract_all(F.lower("_c"), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike(r"^\p{L}{4,}$"))).alias("pos", "w"))
    counts = found.groupBy(key, "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = top_k(counts, [key], [F.col("n").desc(), F.col("first")], 8)
    named = best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]), ", ").alias("_words"))
    start = F.array_join(F.slice(F.split("_c", r"(?<=[.!?])\s+"), 1, 3), " ")
    more = F.when(F.col("_words").isNotNull(), F.concat(F.lit(" Parole chiave thread: "), "_words", F.lit("."))).otherwise("")
    return rows.join(named, key, "left").select(key, F.when(F.col("_c") == "", "").otherwise(F.substring(F.concat(start, more), 1, longest)).alias("summary"))


def attachment_summary(filename: Column, kind: Column, keywords: Column, text: Column, longest: int = 1500) -> Column:
    """One line on an attachment: kind and name, keywords, text; at most ``longest`` characters."""
    head = F.concat(F.lit("Allegato "), kind, F.lit(": "), F.coalesce(F.nullif(filename, F.lit("")), F.lit("senza nome")), F.lit("."))
    words = F.when(F.size(keywords) > 0, F.concat(F.array_join(keywords, ", "), F.lit(".")))
    body = F.when(F.coalesce(text, F.lit("")) != "", F.substring(_compact(text), 1, longest))
    return F.substring(F.concat_ws(" ", head, words, body), 1, longest)


def _docx(payload: bytes) -> str:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{word}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in body.findall(f"{word}p"))


def _xlsx(payload: bytes) -> str:
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    out = []
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        paths = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in islice(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"), SHEETS):
            out.append(f"Foglio: {sheet.get('name')}")
            path = "xl/" + paths[sheet.get(f"{rel}id")].removeprefix("/xl/")
            for row in islice(ElementTree.fromstring(z.read(path)).iter(f"{main}row"), ROWS):
                cells = []
                for c in islice(row.iter(f"{main}c"), CELLS):
                    value = c.find(f"{main}v")
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                    if text:
                        cells.append(text)
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def _pdf(payload: bytes) -> str:
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(payload)).pages[:PAGES])


def read_attachment(payload: bytes | None, filename: str | None, mime: str | None, most: int) -> dict[str, str | None]:
    """text, status (extracted, empty, too_large, unsupported, dependency_missing, error, metadata_only) and error."""
    if payload is None:
        return {"text": None, "status": "metadata_only", "error": None}
    if len(payload) > most:
        return {"text": None, "status": "too_large", "error": None}
    end = "." + filename.rsplit(".", 1)[1].lower() if filename and "." in filename.lstrip(".") else ""
    try:
        if end in (".txt", ".csv") or (mime or "").startswith("text/"):
            text = payload.decode("utf-8", errors="replace")
            if end == ".csv":
                text = "\n".join(" | ".join(r[:CELLS]) for r in islice(csv.reader(io.StringIO(text)), ROWS))
            return {"text": text[:CHARS], "status": "extracted", "error": None}
        reader = {".docx": _docx, ".xlsx": _xlsx, ".pdf": _pdf}.get(end)
        if reader is None:
            return {"text": None, "status": "unsupported", "error": None}
        text = reader(payload)
        return {"text": text[:CHARS], "status": "extracted" if text.strip() else "empty", "error": None}
    except ImportError as e:
        return {"text": None, "status": "dependency_missing", "error": str(e)}
    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failure
        return {"text": None, "status": "error", "error": f"{type(e).__name__}: {e}"}


def attachment_text(payload: Column, filename: Column, mime: Column, most_mb: int = 20) -> Column:
    """``struct<text, status, error>`` of attachments: text and CSV, DOCX and XLSX by the standard library, PDF where a
    reader is installed. Null payloads are ``metadata_only``."""

    @F.arrow_udf("text string, status string, error string")
    def read(payloads: pa.Array, names: pa.Array, mimes: pa.Array) -> pa.Array:
        return pa.array([read_attachment(p.as_py(), n.as_py(), m.as_py(), most_mb << 20) for p, n, m in zip(payloads, names, mimes)], KIND)

    return read(payload, filename, mime)


def attachment_contexts(df: DataFrame, conversation: str, order: str, filename: str, keywords: str, text: str, longest: int = 3000) -> DataFrame:
    """(conversation, context): what the attachments of a conversation say, in order, at most ``longest`` characters.

    Each snippet is cut before it moves, and a group keeps only the first ones that can fill the room: a line end and
    a colon make every snippet at least two characters long.
    """
    snippet = F.concat(F.coalesce(filename, F.lit("")), F.lit(": "), F.coalesce(keywords, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    rows = df.select(conversation, order, F.substring(snippet, 1, longest).alias("s"))
    first = top_k(rows, [conversation], [F.col(order)], longest // 4 + 1)
    return first.groupBy(conversation).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), "\n"), 1, longest).alias("context"))


def contexts(df: DataFrame, key: str, min_chars: int = 120, min_words: int = 12, longest_attachment: int = 1500, excluded: tuple[str, ...] = EXCLUDED_TYPES) -> DataFrame:
    """(key, strategy, excluded, reason, text, quality) from subject, current, thread, thread_summary, message_type, attachment_summary.

    The strategy tells which parts stand for the message: its own words, its thread where it says little, its attachment
    where it points to it. Null parts count as empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    df = df.withColumns({c: text(F.col(c)) for c in ("subject", "current", "thread", "thread_summary", "attachment_summary", "message_type")})
    kind = F.when(F.col("message_type") == "short_ack", "short_reply").otherwise(F.col("message_type"))
    n = F.size(F.filter(F.regexp_extract_all("current", F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) >= 3))
    ends = cleaning.whitespace_ends
    poor = F.length(ends(F.col("current"))) < min_chars
    points = F.col("current").rlike(r"(?iU)\b(in|vedi|trovi|trasmetto).{0,25}allegat")
    out = "exclude_from_main_clustering"
    first = (
        F.when(kind.isin(*excluded), out)
        .when((F.col("attachment_summary") != "") & (points | (n < 12)), "attachment_dominant")
        .when(poor & (F.length(ends(F.col("thread"))) >= min_chars), "thread_dominant")
        .when(n < 5, out)
        .otherwise("current_plus_subject")
    )
    why = F.when(kind.isin(*excluded), F.concat(F.lit("tipo messaggio escluso: "), kind)).when(F.col("_first") == out, "contenuto operativo insufficiente")
    df = df.withColumn("_kind", kind).withColumn("_first", first).withColumn("_why", why)
    parts = F.array(
        ends(F.col("subject")),
        F.when(F.col("_first") == out, "").otherwise(ends(F.col("current"))),
        F.when(F.col("_first") == "thread_dominant", F.col("thread_summary")).otherwise(""),
        F.when(F.col("_first") == "attachment_dominant", F.substring("attachment_summary", 1, longest_attachment)).otherwise(""),
    )
    df = df.withColumn("_text", ends(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")))
    different = F.size(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("_text"), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike(r"^\p{L}{3,}$"))))
    df = df.withColumn("_different", different)
    thin = (F.col("_first") != out) & ((F.length("_text") < min_chars) | (F.col("_different") < min_words))
    strategy = F.when(thin, out).otherwise(F.col("_first"))
    quality = F.least(F.lit(1.0), F.length("_text") / 500.0) * F.least(F.lit(1.0), F.col("_different") / 30.0)
    return df.select(
        key, strategy.alias("strategy"), (strategy == out).alias("excluded"), F.when(thin, "contesto semantico sotto soglia").otherwise(F.col("_why")).alias("reason"),
        F.col("_text").alias("text"), F.round(quality, 3).alias("quality"),
    )
