"""Text expressions: all built-in, so they stay in generated code and below the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# What marks a reply or forward in a subject, and telling words of six languages.
REPLY = r"(?i)^\s*(?:(?:re|r|rif|aw|wg|fw|fwd|i|tr|rv)\s*:\s*)+"
TELLING = {
    "it": ["che", "della", "sono", "questo", "per", "non"], "en": ["the", "and", "with", "for", "that", "will"], "de": ["der", "und", "nicht", "für", "das", "mit"],
    "fr": ["les", "des", "est", "pour", "une", "dans"], "es": ["los", "una", "del", "que", "las", "con"], "pt": ["uma", "não", "para", "dos", "com", "em"],
}


def whitespace(c: Column) -> Column:
    """Line ends to LF, runs of blanks to one, at most one empty line in a row, nothing at the ends."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t ]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def subject(c: Column) -> Column:
    """A subject without reply and forward marks, lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), REPLY, ""), r"\s+", " ")))


def words(c: Column, least: int = 2) -> Column:
    """Lower-case words of at least ``least`` letters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([a-zà-öø-ÿ]{{{least},}})"), 1)


def lines(c: Column) -> Column:
    """Lines without blanks at their ends, empty ones dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def quality(c: Column, min_chars: int = 40, min_words: int = 5) -> Column:
    """0.4 share of ``10 * min_chars`` characters + 0.4 share of ``10 * min_words`` different words + 0.2 diversity."""
    w = words(c)
    different = F.size(F.array_distinct(w)).cast("double")
    chars = F.least(F.length(c) / F.lit(10.0 * min_chars), F.lit(1.0))
    return 0.4 * chars + 0.4 * F.least(different / (10.0 * min_words), F.lit(1.0)) + 0.2 * F.when(F.size(w) > 0, different / F.size(w)).otherwise(0.0)


def language(c: Column) -> Column:
    """The language with most telling words among the words of a text, ties alphabetically, null without any."""
    w = words(c)
    told = lambda t: F.size(F.filter(w, lambda x: x.isin(*t)))
    score = F.array(*[F.struct((-told(t)).alias("n"), F.lit(code).alias("code")) for code, t in sorted(TELLING.items())])
    best = F.array_min(score)
    return F.when(best["n"] < 0, best["code"])


def chunks(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; none starts once one has reached the end."""
    step = size - overlap
    n = F.length(c)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int"))
    return F.when(n > 0, F.transform(starts, lambda i: F.substr(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def domains(c: Column) -> Column:
    """Domains of all addresses in a text, lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"@([a-z0-9.-]+[a-z0-9])"), 1)


def html(c: Column) -> Column:
    """Visible text of HTML: scripts, styles and comments dropped, tags to line ends, common entities decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", "\n")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.array_join(lines(c), "\n")


def sentences(c: Column) -> Column:
    """Sentences: cut after a stop that white space follows."""
    return F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: x.rlike(r"[^\s\p{Z}]"))


def segments(c: Column) -> Column:
    """Fold over the lines with a sticky state: ``struct<current, quoted, signature>`` of line arrays.

    A quoting mark or a reply header moves to ``quoted`` for good, a separator to ``signature``.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("c").alias("state"), empty.alias("current"), empty.alias("quoted"), empty.alias("signature"))

    def step(acc: Column, line: Column) -> Column:
        quoted = line.startswith(">") | line.rlike(r"^-{3,}.*\w.*-{3,}$") | line.rlike(r"(?:ha scritto|wrote|schrieb|a écrit|escribió).*:$")
        state = F.when(quoted | (acc["state"] == "q"), "q").when(line.rlike(r"^(?:--|_{3,})$") | (acc["state"] == "s"), "s").otherwise("c")
        put = lambda name, s: F.when(state == s, F.concat(acc[name], F.array(line))).otherwise(acc[name]).alias(name)
        return F.struct(state.alias("state"), put("current", "c"), put("quoted", "q"), put("signature", "s"))

    return F.aggregate(lines(c), start, step)


def first_match(c: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first rule with a marker in the text (case ignored)."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, markers in rules:
        hit = F.lit(False)
        for m in markers:
            hit = hit | low.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)
