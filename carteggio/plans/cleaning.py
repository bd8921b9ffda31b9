"""Queries of text cleaning, contexts and attachments, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from carteggio.functions import cleaning as C
from carteggio.functions import text as T
from carteggio.operators import contexts
from carteggio.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the same rules in SQL: lines as rows, boundaries of words spelled out


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rr(c: str, rule: str, by: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({c}, {_lit(rule)}, {by}, {_lit(flags)})"


def _between(c: str, rule: str, flags: str = "g") -> str:
    for _ in range(2):  # neighbours share a boundary, so every other match is left for a second pass
        c = _rr(c, rf"(^|[^\pL\pN_]){rule}([^\pL\pN_]|$)", r"'\1 \2'", flags)
    return c


def _ends(c: str) -> str:
    return _rr(c, r"^[\s\pZ]+|[\s\pZ]+$")


def _white(c: str) -> str:
    c = _rr(_rr(c, r"\r\n?", "chr(10)"), r"[ \t" + " " + "]+", "' '")
    return _ends(_rr(c, r"\n{3,}", "chr(10) || chr(10)"))


def _noise(c: str) -> str:
    for form in C.DATES:
        c = _between(c, form)
    c = _between(c, f"(?:{'|'.join(C.HEADER_WORDS)})", "gi")
    return _rr(_rr(c, "[_-]{2,}", "' '"), r"[ \t]+", "' '")


def _blanked(c: str) -> str:
    tokens = f"regexp_extract_all({c}, '[A-Za-zÀ-ÿ]{{3,}}')"
    return f"case when len({tokens}) > 0 and len(list_filter({tokens}, lambda t: lower(t) not in ({', '.join(map(_lit, C.HEADER_WORDS))}))) = 0 then '' else {c} end"


def _contains(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {_lit(w)})" for w in words) + ")"


_MAIL_SUBJECT = _rr(_rr("replace(coalesce(subject, ''), chr(160), ' ')", r"^(?:(?:re|fw|fwd|rif|inoltro)\s*:\s*)+", flags="i"), r"\[(?:spam|external|esterno)\]\s*", flags="gi")
_SUBJECTS = f"u0 as (select id, {_white(_noise(_MAIL_SUBJECT))} as s from emails), u as (select id, {_blanked('s')} as subject_clean from u0)"
_LINE = "regexp_matches({c}, {r}, 'i')"
_M = "lower(trim(raw))"
_QUOTED = " or ".join(f"regexp_matches({_ends('lower(raw)')}, {_lit('^(?:' + q + ')$')})" for q in C.QUOTES)
_MARKED = f"""b as (select id, string_split({_white("replace(coalesce(body_plain, ''), chr(160), ' ')")}, chr(10)) as l from emails), r as (select id, unnest(l) as raw, generate_subscripts(l, 1) as n from b),
 k as (select id, n, raw, {_ends('lower(raw)')} as m from r),
 j as (select id, n, raw, case when starts_with(m, '>') then 'q' when {_QUOTED} then case when contains(m, 'forward') or contains(m, 'inoltrato') then 'f' else 'q' end
   when {' or '.join(f'starts_with(m, {_lit(x)})' for x in C.DISCLAIMERS)} then 'd' when {' or '.join(f'starts_with(m, {_lit(x)})' for x in C.SIGNATURES)} or m = '--' then 's'
   when {_contains('m', C.NEWSLETTER)} then 'n' when regexp_matches(m, {_lit('^(?:' + C.HEADER_LINE + ')$')}) then 't' end as k from k),
 f as (select *, min(n) filter (k in ('q', 'f', 'd', 's', 'n')) over (partition by id) as first from j),
 g as (select id, n, raw, coalesce(last_value(case when n >= first then k end ignore nulls) over (partition by id order by n rows unbounded preceding), 'c') as k from f)"""
_LOW = " or ".join(f"regexp_matches(x, {_lit('^(?:' + w.replace(chr(92) + 'b', '(?:^|$|[^' + chr(92) + 'pL' + chr(92) + 'pN_])') + ')$')}, 'i')" for w in C.LOW_SIGNAL)
_CURRENT = f"""h0 as (select id, n, {_ends(_noise(_rr(_rr('raw', r'\[?cid:[^\] >]+\]?', flags='gi'), r'<https?://[^>]+>', flags='gi')))} as x from g where k = 'c'),
 h1 as (select id, n, {_blanked('x')} as x from h0), h2 as (select id, n, x from h1 where x <> '' and not ({_LOW})), h as (select id, {_ends("string_agg(x, chr(10) order by n)")} as current from h2 group by 1)"""
_WORDS = "list_filter(regexp_extract_all({c}, '([\\pL\\pN_]+)', 1), lambda w: regexp_matches(w, '^\\pL{{{n},}}$'))"
_TYPE = "case " + " ".join(f"when {_contains('low', m)} then '{k}'" for k, m in C.TYPES) + f""" when has_attachments = 1 and (len(w) = 0 or len(w) <= 12 and regexp_matches(j, {_lit('(?:^|[^\\pL\\pN_])' + C.ATTACHED[2:])}, 'i')) then 'attachment_only'
 when len(w) = 0 and regexp_matches(subject_clean, 'inoltrat|forward', 'i') then 'forward_only' when len(w) <= 5 and regexp_matches(lower(array_to_string(w, ' ')), {_lit('^(?:' + C.ACKNOWLEDGED + ')$')}) then 'short_ack'
 when len(list_distinct(list_transform(w, lambda y: lower(y)))) < 4 then 'low_information' else 'operational_email' end"""
_NEWS = f"nl as (select id, string_agg(raw, chr(10) order by n) as news from g where k = 'n' group by 1)"
_ALL = f"""{_SUBJECTS}, {_MARKED}, {_CURRENT}, {_NEWS}, p as (select e.id, e.has_attachments, u.subject_clean, coalesce(h.current, '') as cur, coalesce(h.current, '') || coalesce(chr(10) || news, '') as j from emails e join u on u.id = e.id left join h on h.id = e.id left join nl on nl.id = e.id),
 q as (select *, lower(subject_clean || chr(10) || j) as low, {_WORDS.format(c='j', n=2)} as w, {_ends("substring(" + _ends("array_to_string(list_filter([subject_clean, cur], lambda z: z <> ''), chr(10) || chr(10))") + ", 1, 12000)")} as semantic from p),
 s as (select *, {_WORDS.format(c='lower(semantic)', n=2)} as sw, {_TYPE} as message_type from q)"""
_SCORE = "round(0.4 * least(length(semantic) / 240.0, 1.0) + 0.4 * least(len(list_distinct(sw)) / 16.0, 1.0) + 0.2 * least(len(list_distinct(sw)) / greatest(len(sw), 1)::double, 1.0), 3)"
_WHY = f"case when message_type in ({', '.join(map(_lit, C.EXCLUDED_TYPES))}) then 'tipo messaggio escluso: ' || message_type when length(semantic) < 80 then 'semantic_text sotto 80 caratteri' when len(list_distinct(sw)) < 8 then 'meno di 8 parole uniche' end"


@query(f"with {_SUBJECTS} select id, subject_clean from u")
def text_noise(spark, root):
    return table(spark, root, "emails").select("id", C.subject(F.col("subject")).alias("subject_clean"))


@query(f"with {_MARKED} select id, " + ", ".join(f"md5({_white(f'''coalesce(string_agg(raw, chr(10) order by n) filter (k = '{s}'), '')''')}) as {n}" for n, s in C.SEGMENTS.items()) + ", count(*) filter (k = 'c') > 0 as has_current from g group by 1")
def text_segments8(spark, root):
    s = table(spark, root, "emails").select("id", C.segments(T.whitespace(C.unescape(F.coalesce("body_plain", F.lit(""))))).alias("s"), F.coalesce("body_plain", F.lit("")).alias("b"))
    first = F.regexp_replace(F.split(T.whitespace(F.replace("b", F.lit(" "), F.lit(" "))), "\n")[0], "^$", "x")
    return s.select("id", *[F.md5(T.whitespace(F.col(f"s.{n}"))).alias(n) for n in C.SEGMENTS], ((F.col("s.current") != "") | (first == "x") & (F.col("b").rlike(r"^[\s\p{Z}]*$"))).alias("has_current"))


@query(f"with {_MARKED}, {_CURRENT} select e.id, md5(coalesce(current, '')) as current_md5, length(coalesce(current, '')) as chars from emails e left join h on h.id = e.id")
def text_line_filter(spark, root):
    e = table(spark, root, "emails").select("id", C.segments(T.whitespace(C.unescape(F.coalesce("body_plain", F.lit(""))))).alias("s"))
    current = C.current_message(F.col("s.current"))
    return e.select("id", current.alias("c")).select("id", F.md5("c").alias("current_md5"), F.length("c").cast("long").alias("chars"))


@query(f"with {_ALL} select message_type, count(*) as n, min(id) as first_id, sum(length(semantic))::bigint as chars from s group by 1")
def text_message_type(spark, root):
    c = C.clean_text(table(spark, root, "emails"))
    return c.groupBy("message_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum(F.length("semantic_text")).alias("chars"))


@query(f"with {_ALL} select id, subject_clean, md5(cur) as current_md5, md5(semantic) as semantic_md5, message_type, {_SCORE} as quality_score, {_WHY} as exclusion_reason from s")
def clean_text(spark, root):
    c = C.clean_text(table(spark, root, "emails"))
    return c.select("id", "subject_clean", F.md5("body_current_message_clean").alias("current_md5"), F.md5("semantic_text").alias("semantic_md5"), "message_type", "quality_score", "exclusion_reason")


@query("select doc_id, case when i + e > 0 then case when i >= e then 'it' else 'en' end end as language from (select doc_id, " + ", ".join(
    f"({' + '.join(f'contains(t, {_lit(w)})::int' for w in ws)}) as {n}" for n, ws in (("i", C.ITALIAN), ("e", C.ENGLISH))) + " from (select doc_id, ' ' || lower(substring(text, 1, 3000)) || ' ' as t from documents where text is not null))")
def text_language_two(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", C.language(F.col("text")).alias("language"))


_THREAD = f"""t as (select email_id as id, max_by(struct_pack(s := coalesce(subject_clean, ''), c := coalesce(body_current_message_clean, ''), m := message_type, t := coalesce(quoted_thread_text, '')), id) as r from clean_texts group by 1),
 c as (select id, {_ends(_rr("r.t", r"[\s\pZ]+", "' '"))} as c from t), w as (select id, unnest({_WORDS.format(c='lower(c)', n=4)}) as w, generate_subscripts({_WORDS.format(c='lower(c)', n=4)}, 1) as p from c),
 n as (select id, w, count(*) as n, min(p) as p from w group by 1, 2), b as (select id, string_agg(w, ', ' order by rk) as words from (select *, row_number() over (partition by id order by n desc, p) as rk from n) where rk <= 8 group by 1),
 y as (select c.id, case when c = '' then '' else substring(array_to_string(string_split({_rr("c", r"([.!?]) ", "'\\1' || chr(1)")}, chr(1))[1:3], ' ') || coalesce(' Parole chiave thread: ' || words || '.', ''), 1, 1500) end as summary from c left join b on b.id = c.id)"""


def _threads(spark, root):
    from carteggio.operators.relational import latest

    c = latest(table(spark, root, "clean_texts").select("email_id", "id", "subject_clean", "body_current_message_clean", "message_type", "quoted_thread_text"), ["email_id"], ["id"])
    return c.select(F.col("email_id").alias("id"), F.col("subject_clean").alias("subject"), F.col("body_current_message_clean").alias("current"), F.col("quoted_thread_text").alias("thread"), "message_type")


@query(f"with {_THREAD} select id, summary from y")
def thread_summary(spark, root):
    return contexts.thread_summaries(_threads(spark, root), "id", "thread")


@query(f"""with {_THREAD}, z as (select t.id, r.s as s, r.c as cur, r.t as th, y.summary, case when r.m = 'short_ack' then 'short_reply' else coalesce(r.m, '') end as m, len(list_filter(regexp_extract_all(r.c, '([\\pL\\pN_]+)', 1), lambda w: length(w) >= 3)) as n from t join y on y.id = t.id),
 f as (select *, case when m in ({', '.join(map(_lit, contexts.EXCLUDED_TYPES))}) then 'exclude_from_main_clustering' when length({_ends('cur')}) < 120 and length({_ends('th')}) >= 120 then 'thread_dominant' when n < 5 then 'exclude_from_main_clustering' else 'current_plus_subject' end as f from z),
 g as (select *, {_ends(f"array_to_string(list_filter([{_ends('s')}, case when f = 'exclude_from_main_clustering' then '' else {_ends('cur')} end, case when f = 'thread_dominant' then summary else '' end], lambda x: x <> ''), chr(10) || chr(10))")} as text from f),
 d as (select *, len(list_distinct({_WORDS.format(c='lower(text)', n=3)})) as d from g), x as (select *, f <> 'exclude_from_main_clustering' and (length(text) < 120 or d < 12) as thin from d)
 select id, case when thin then 'exclude_from_main_clustering' else f end as strategy, case when thin then 'contesto semantico sotto soglia' when m in ({', '.join(map(_lit, contexts.EXCLUDED_TYPES))}) then 'tipo messaggio escluso: ' || m
 when f = 'exclude_from_main_clustering' then 'contenuto operativo insufficiente' end as reason, md5(text) as text_md5, round(least(1.0, length(text) / 500.0) * least(1.0, d / 30.0), 3) as quality from x""")
def semantic_context(spark, root):
    t = _threads(spark, root)
    t = t.join(contexts.thread_summaries(t, "id", "thread").withColumnRenamed("summary", "thread_summary"), "id").withColumn("attachment_summary", F.lit(""))
    return contexts.contexts(t, "id").select("id", "strategy", "reason", F.md5("text").alias("text_md5"), "quality")


@query("select doc_id, case when text is null then 'metadata_only' when strlen(text) > 1048576 then 'too_large' when doc_id % 3 = 2 then 'unsupported' else 'extracted' end as status, case when doc_id % 3 <> 2 and strlen(text) <= 1048576 then md5(substring(text, 1, 100000)) end as text_md5 from documents")
def attachment_texts(spark, root):
    # every document as the payload of an attachment whose name ends in one of three ways
    d = table(spark, root, "documents").select("doc_id", F.encode("text", "utf-8").alias("p"), F.concat(F.lit("f"), F.element_at(F.array(F.lit(".txt"), F.lit(".TXT"), F.lit(".bin")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("n"))
    return d.select("doc_id", contexts.attachment_text(F.col("p"), F.col("n"), F.lit(None).cast("string"), 1).alias("a")).select("doc_id", "a.status", F.md5("a.text").alias("text_md5"))


@query(f"""with a as (select email_id, doc_id, 'Allegato ' || doc_type || ': f' || doc_id || '.txt.' || case when lang is not null then ' ' || lang || '.' else '' end || case when coalesce(text, '') <> '' then ' ' || substring({_ends(_rr('text', r'[\s\pZ]+', "' '"))}, 1, 1500) else '' end as s from documents where email_id is not null and doc_type is not null)
 select email_id, count(*) as n, md5(substring(string_agg(substring(s, 1, 1500), chr(10) order by doc_id), 1, 3000)) as context_md5 from (select email_id, doc_id, 'f' || doc_id || ': ' || ' ' || substring(s, 1, 1500) as s from a) group by 1""".replace("substring(string_agg(substring(s, 1, 1500)", "substring(string_agg(substring(s, 1, 3000)"))
def attachment_contexts(spark, root):
    d = table(spark, root, "documents").where("email_id is not null and doc_type is not null")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    s = contexts.attachment_summary(F.concat(name, F.lit(".txt")), F.col("doc_type"), F.filter(F.array("lang"), lambda x: x.isNotNull()), F.col("text"))
    rows = d.select("email_id", "doc_id", name.alias("name"), s.alias("s"))
    n = rows.groupBy("email_id").agg(F.count("*").alias("n"))
    return contexts.attachment_contexts(rows.withColumn("k", F.lit("")), "email_id", "doc_id", "name", "k", "s").join(n, "email_id").select("email_id", "n", F.md5("context").alias("context_md5"))
