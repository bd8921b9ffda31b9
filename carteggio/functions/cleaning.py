"""Cleaning of message texts: noise, segments, message types, quality and the assembled clean text.

All but :func:`unescape` are built-in expressions over whole texts: rules for lines are multi-line regular expressions, so
no array of lines is built and no text is copied once per line. ``\\w`` and ``\\b`` are meant for all scripts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from carteggio.functions.text import whitespace

# Words of mail headers, forms of dates that are noise, marks of segments, markers of message types.
HEADER_WORDS = ("bcc", "cc", "come", "data", "date", "from", "message", "sent", "subject", "to", "your")
DATES = (r"\d{1,2}[/_-]\d{1,2}[/_-]\d{2,4}", r"\d{4}[/_-]\d{1,2}[/_-]\d{1,2}", r"\d{1,2}[/_-]\d{4}")
QUOTES = (
    r"-----\s*(?:original message|messaggio originale)\s*-----.*",
    r"inizio messaggio inoltrato.*",
    r"begin forwarded message.*",
    r"il giorno .+ ha scritto:?",
    r"on .+ wrote:?",
)
DISCLAIMERS = (
    "questo messaggio e i suoi allegati", "le informazioni contenute nella presente",
    "ai sensi del regolamento", "informativa privacy", "this message and any attachments",
    "the information contained in this message", "this email is intended only",
    "if you are not the intended recipient",
    "this e-mail and any attachments", "this email and any attachments",
    "the contents of this message", "any unauthorised use", "any unauthorized use",
    "please consider the environment", "think before print", "think before you print",
)
SIGNATURES = ("cordiali saluti", "distinti saluti", "cordialmente", "best regards", "kind regards")
HEADER_LINE = r"(?:da|from|inviato|sent|a|to|cc|oggetto|subject):\s*.+"
TYPES = (
    ("pec_receipt", ("ricevuta di accettazione", "ricevuta di avvenuta consegna", "posta certificata", "gestore di posta certificata", "daticert.xml", "smime.p7s")),
    ("delivery_notification", ("delivery status notification", "undeliverable", "mail delivery subsystem", "mailer-daemon", "mancata consegna", "delivery has failed", "failure notice")),
    ("calendar_message", ("riunione di microsoft teams", "fai clic qui per partecipare", "google calendar", "invito:", "invitation:", "when:", "quando:", "ics attachment")),
    ("newsletter", ("annulla iscrizione", "unsubscribe", "non visualizzi questa email", "view this email in your browser", "se non desideri ricevere", "preferenze email")),
    ("auto_generated", ("messaggio generato automaticamente", "do not reply", "non rispondere a questa email", "cubesuite", "registrazione ingresso", "notifica automatica", "il tuo ordine amazon", "amazon.it di", "risposta automatica:")),
    ("personal_or_commercial_notification", ("amazon", "trenitalia", "paypal", "account microsoft", "microsoft account", "accesso insolito", "codice di sicurezza", "il tuo pacco", "il tuo ordine",
                                             "webinar", "iscriviti all'evento", "iscriviti al webinar", "evento online", "conferma registrazione", "ticket", "programma eventi")),
)
NEWSLETTER = dict(TYPES)["newsletter"]
ACKNOWLEDGED = r"(?:ok|okay|grazie|thanks|ricevuto|perfetto|va bene|bene|ciao|saluti)[ .,!]*(?:grazie|thanks)?"
ATTACHED = r"\b(?:in|vedi|trovi|trasmetto).{0,25}allegat"
EXCLUDED_TYPES = ("short_ack", "auto_generated", "pec_receipt", "delivery_notification", "calendar_message", "newsletter", "attachment_only", "forward_only", "low_information")
ITALIAN, ENGLISH = (" il ", " la ", " che ", " per ", " della ", " con "), (" the ", " and ", " for ", " with ", " this ", " from ")
LOW_SIGNAL = (
    r"[>_\-=* .]{2,}",
    r"(?:https?://|www\.)\S+",
    r"[\w.+-]+@[\w.-]+\.\w+",
    r"(?:tel|fax|cell|mobile|pec|e-mail)[: .+\d()/\-]+",
    r".*\b(?:p\.?\s*iva|partita iva|codice fiscale|c\.?f\.?)\b.*",
    r".*\b(?:via|viale|piazza|corso)\b.+\b\d{5}\b.*",
    r"(?:\[immagine|image:|mailto:|curriculum vitae).*",
)
#: Segments in the order of their rules, with the sign each is marked by; what stands before the first mark is current.
SEGMENTS = {"quoted": "q", "forwarded": "f", "disclaimer": "d", "signature": "s", "newsletter": "n", "technical": "t"}

_MARK = "\u0001"
_BLANK = r"[ \t\x0B\f\r\x1c-\x1f\x85\p{Z}]"
_LETTER = "[A-Za-zÀ-ÿ]"


def unescape(c: Column) -> Column:
    """Entities of HTML decoded, no-break spaces to blanks. Null stays null."""
    import html

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array([html.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.string())

    return decode(F.replace(c, F.lit(" "), F.lit(" ")))


def inline_links(c: Column) -> Column:
    """Without embedded images and links in angle brackets."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)\[?cid:[^\] >\n]+\]?", ""), r"(?i)<https?://[^>\n]+>", "")


def _any(words) -> str:
    return "|".join(words)


def noise(c: Column, by_line: bool = False) -> Column:
    """Without dates, words of mail headers and rulers; empty if only such words remain.

    ``by_line`` judges every line on its own (and trims it); else the text as a whole.
    """
    for form in DATES:
        c = F.regexp_replace(c, rf"(?U)\b{form}\b", " ")
    c = F.regexp_replace(c, rf"(?iU)\b(?:{_any(HEADER_WORDS)})\b", " ")
    c = F.regexp_replace(F.regexp_replace(c, "[_-]{2,}", " "), r"[ \t]+", " ")
    c = F.regexp_replace(c, rf"(?m)^{_BLANK}+|{_BLANK}+$", "") if by_line else whitespace(c)
    other = rf"(?:[^A-Za-zÀ-ÿ]|(?<!{_LETTER}){_LETTER}{{1,2}}(?!{_LETTER})|(?<!{_LETTER})(?i:{_any(w for w in HEADER_WORDS if len(w) > 2)})(?!{_LETTER}))"
    if by_line:
        return F.regexp_replace(c, rf"(?md)^(?=.*{_LETTER}{{3}}){other.replace('[^A-Za-zÀ-ÿ]', '[^A-Za-zÀ-ÿ' + chr(92) + 'n]')}++$", "")
    return F.when(c.rlike(rf"{_LETTER}{{3}}") & c.rlike(rf"(?s)^{other}++$"), "").otherwise(c)


def subject(c: Column) -> Column:
    """A subject without reply marks, tags of mail filters and noise."""
    c = F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), r"(?i)^(?:(?:re|fw|fwd|rif|inoltro)\s*:\s*)+", "")
    return noise(F.regexp_replace(c, r"(?i)\[(?:spam|external|esterno)\]\s*", ""))


def low_signal_lines(c: Column) -> Column:
    """A text whose lines that tell little (rulers, bare links, addresses, phones, tax numbers) are empty."""
    return F.regexp_replace(c, rf"(?miUd)^(?:{_any(LOW_SIGNAL)})$", "")


def current_message(c: Column) -> Column:
    """Lines without noise; empty ones and those that tell little are dropped."""
    c = low_signal_lines(noise(inline_links(c), by_line=True))
    return whitespace(F.regexp_replace(c, r"\n{2,}", "\n"))


def segments(c: Column) -> Column:
    """``struct<current, quoted, forwarded, disclaimer, signature, newsletter, technical>`` of a text with LF line ends.

    A marked line moves to its segment, and so do the lines after it until the next mark; nothing returns to ``current``.
    A header line counts only outside of it. Each segment is the text of its lines.
    """
    c = F.regexp_replace(F.replace(c, F.lit(_MARK), F.lit("")), r"[\x0B\f\x1c-\x1e\x85  ]", "\n")
    put = lambda c, sign, rule: F.regexp_replace(c, rf"(?miUd)^(?!{_MARK})(?={_BLANK}*(?:{rule}))", _MARK + sign)
    end = rf"{_BLANK}*$"
    c = put(c, "q", ">")
    c = put(c, "f", rf"(?=.*(?:forward|inoltrato))(?:{_any(QUOTES)}){end}")
    c = put(c, "q", rf"(?:{_any(QUOTES)}){end}")
    c = put(c, "d", _any(DISCLAIMERS))
    c = put(c, "s", rf"{_any(SIGNATURES)}|--{end}")
    c = put(c, "n", rf".*(?:{_any(NEWSLETTER)})")
    c = put(c, "t", HEADER_LINE)
    first = F.regexp_instr(c, F.lit(_MARK + "[qfdsn]"))
    head = F.when(first > 0, F.substr(c, F.lit(1), first - 1)).otherwise(c)
    tail = F.when(first > 0, F.substr(c, first)).otherwise("")
    of = lambda sign: F.array_join(F.regexp_extract_all(tail, F.lit(f"{_MARK}{sign}([^{_MARK}]*)"), 1), "")
    return F.struct(F.replace(head, F.lit(_MARK + "t"), F.lit("")).alias("current"), *[of(s).alias(n) for n, s in SEGMENTS.items()])


def words(c: Column) -> Column:
    """Words of at least two letters that touch no digit or underscore, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike(r"^\p{L}{2,}$"))


def message_type(subject: Column, body: Column, has_attachments: Column) -> Column:
    """The first kind of message with a marker in subject or body, then by what the body says at all."""
    low = F.lower(F.concat(subject, F.lit("\n"), body))
    w = words(body)
    n, different = F.size(w), F.size(F.array_distinct(F.transform(w, F.lower)))
    out = None
    for kind, markers in TYPES:
        hit = low.contains(markers[0])
        for m in markers[1:]:
            hit = hit | low.contains(m)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    attached = F.coalesce(has_attachments.cast("boolean"), F.lit(False))
    return (
        out.when(attached & ((n == 0) | (n <= 12) & body.rlike("(?iU)" + ATTACHED)), "attachment_only")
        .when((n == 0) & subject.rlike("(?i)inoltrat|forward"), "forward_only")
        .when((n <= 5) & F.lower(F.array_join(w, " ")).rlike(f"^(?:{ACKNOWLEDGED})$"), "short_ack")
        .when(different < 4, "low_information")
        .otherwise("operational_email")
    )


def quality(c: Column, min_chars: int = 80, min_words: int = 8) -> Column:
    """``struct<score, reason>``: share of three times the least length, twice the least number of different words, diversity."""
    w = words(F.lower(c))
    n, different = F.size(w), F.size(F.array_distinct(w)).cast("double")
    share = lambda x, of: F.least(x / F.lit(float(max(of, 1))), F.lit(1.0))
    score = 0.4 * share(F.length(c), 3 * min_chars) + 0.4 * share(different, 2 * min_words) + 0.2 * F.least(different / F.greatest(n, F.lit(1)), F.lit(1.0))
    reason = F.when(F.length(whitespace(c)) < min_chars, f"semantic_text sotto {min_chars} caratteri").when(different < min_words, f"meno di {min_words} parole uniche")
    return F.struct(F.round(score, 3).alias("score"), reason.alias("reason"))


def language(c: Column) -> Column:
    """``it`` or ``en`` by common words in the first 3,000 characters, ``it`` on a tie, null without any."""
    low = F.concat(F.lit(" "), F.lower(F.substring(c, 1, 3000)), F.lit(" "))
    told = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    it, en = told(ITALIAN), told(ENGLISH)
    return F.when(it + en > 0, F.when(it >= en, "it").otherwise("en"))


def clean_text(df, subject_column: str = "subject", body: str = "body_plain", attachments: str = "has_attachments",
               min_chars: int = 80, min_words: int = 8, longest: int = 12_000, excluded: tuple[str, ...] = EXCLUDED_TYPES):
    """``df`` plus subject_clean, body_current_message_clean, semantic_text, message_type, quality_score, excluded,
    exclusion_reason, language and the text of every segment. Null subjects and bodies count as empty."""
    df = df.withColumns({"subject_clean": subject(F.col(subject_column)), "_s": segments(whitespace(unescape(F.coalesce(body, F.lit("")))))})
    df = df.withColumn("body_current_message_clean", current_message(F.col("_s.current")))
    both = F.array_join(F.filter(F.array("subject_clean", "body_current_message_clean"), lambda x: x != ""), "\n\n")
    df = df.withColumn("semantic_text", whitespace_ends(F.substring(whitespace_ends(both), 1, longest)))
    judged = F.concat("body_current_message_clean", F.when(F.col("_s.newsletter") != "", F.concat(F.lit("\n"), "_s.newsletter")).otherwise(""))
    df = df.withColumns({"message_type": message_type(F.col("subject_clean"), judged, F.col(attachments)), "_q": quality(F.col("semantic_text"), min_chars, min_words), "language": language(F.col("semantic_text"))})
    reason = F.when(F.col("message_type").isin(*excluded), F.concat(F.lit("tipo messaggio escluso: "), "message_type")).otherwise(F.col("_q.reason"))
    df = df.withColumns({"quality_score": F.col("_q.score"), "exclusion_reason": reason, "excluded": reason.isNotNull()})
    texts = {f"{n}_text": whitespace(F.col(f"_s.{n}")) for n in SEGMENTS}
    return df.withColumns(texts).drop("_s", "_q")


def whitespace_ends(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
