"""Conversations by headers with subject, people and time as a fallback, each query beside the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carteggio.functions import cleaning
from carteggio.operators import conversations as C
from carteggio.operators.relational import latest
from carteggio.plans.cleaning import _SUBJECTS, _ends
from carteggio.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_ID = "nullif(lower(regexp_replace(trim({c}), '^[<>]+|[<>]+$', '', 'g')), '')"
_IDS = "coalesce(regexp_extract_all(try_cast(raw_headers_json as json) ->> '$.{n}', '<([^>]+)>', 1), [])"
_GRAPH = f"""recursive {_SUBJECTS}, m as (select e.id, imported_at as ts, {_ID.format(c='original_message_id')} as own, message_hash, list_concat({_IDS.format(n='References')}, {_IDS.format(n='In-Reply-To')}) as cited, lower(u.subject_clean) as subject_key,
   list_sort(list_distinct(list_filter(list_transform(list_concat([sender], coalesce(from_json(try_cast(recipients as json), '["VARCHAR"]'), [])), lambda x: lower(trim(x))), lambda x: x is not null and x <> ''))) as people from emails e join u on u.id = e.id),
 o as (select own, arg_max(id, (ts, id)) as target from m where own is not null group by 1), c as (select distinct id, {_ID.format(c='x')} as own from (select id, unnest(cited) as x from m)),
 h as (select distinct c.id, o.target from c join o on o.own = c.own),
 l as (select id, subject_key, lag(id) over w as target, coalesce(abs(floor((epoch_us(ts) - epoch_us(lag(ts) over w)) / 86400000000)) <= 45 and list_has_any(people, lag(people) over w), false) as linked
   from m where length(subject_key) >= 8 and subject_key not in ('documenti', 'richiesta', 'aggiornamento', 'comunicazione', 'informazioni') window w as (partition by subject_key order by ts, id)),
 s as (select id, target from l where linked and id not in (select id from h)), g as (select id as a, target as b from h union select id, target from s), d as (select a, b from g union select b, a from g),
 r(id, root) as (select id, id from m union select d.b, r.root from r join d on d.a = r.id), k as (select id, min(root) as conversation_id from r group by 1),
 v as (select k.id, conversation_id, case when k.id in (select id from h) then 'headers' when k.id in (select id from s) then 'subject_participants_date' else 'isolated' end as relation from k),
 w as (select conversation_id, case min(case relation when 'headers' then 0 when 'subject_participants_date' then 1 else 2 end) when 0 then 'headers' when 1 then 'subject_participants_date' else 'isolated' end as method, count(*) as message_count from v group by 1),
 x as (select *, case method when 'headers' then 0.95 when 'isolated' then 0.4 else 0.65 end as confidence, method <> 'headers' as warned from w)"""


def _messages(spark, root):
    e = table(spark, root, "emails")
    return e.select(
        "id", F.col("imported_at").alias("at"), C.message_id(F.col("original_message_id")).alias("own"), C.cited_ids(F.col("raw_headers_json")).alias("cited"),
        F.lower(cleaning.subject(F.col("subject"))).alias("subject_key"), F.array_sort(C.people(e)).alias("participants"), "message_hash",
    )


def _built(spark, root):
    members = C.reconstruct(_messages(spark, root))
    sizes = members.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    return members, C.graded(members).join(sizes, "conversation_id")


@query(f"with {_GRAPH} select id, conversation_id, relation from v")
def conv_rebuilt(spark, root):
    return C.reconstruct(_messages(spark, root))


@query(f"with {_GRAPH} select conversation_id, method, confidence, message_count, warned from x")
def conv_graded(spark, root):
    return _built(spark, root)[1].select("conversation_id", "method", "confidence", "message_count", F.col("warning").isNotNull().alias("warned"))


_REPORT = """y as (select count(*) as conversations, coalesce(sum(message_count), 0)::bigint as emails, count(*) filter (message_count = 1) as isolated, count(*) filter (message_count > 1) as multi_message, count(*) filter (method = 'headers') as header_based,
 count(*) filter (method = 'subject_participants_date') as fallback_based, count(*) filter (confidence < 0.6) as low_confidence from x), z as (select count(*) filter (relation = 'headers') as explicit_links, count(*) filter (relation = 'subject_participants_date') as fallback_links from v),
 n as (select count(*) as general_subjects from m where subject_key <> '' and (length(subject_key) < 8 or subject_key in ('documenti', 'richiesta', 'aggiornamento', 'comunicazione', 'informazioni')))
 select *, round(isolated * 100 / greatest(conversations, 1), 1) as isolated_percent, round(emails / greatest(conversations, 1), 2) as mean_messages, round(1 - conversations / greatest(emails, 1), 3) as reduction_ratio,
 case when conversations = 0 then 'Non verificabile' when isolated * 100 / conversations >= 75 or fallback_based > header_based and low_confidence >= conversations / 2 then 'Fragile' when header_based >= 3 and multi_message >= 3 then 'Buono' else 'Accettabile' end as judgement from y, z, n"""


@query(f"with {_GRAPH}, {_REPORT}")
def conv_report(spark, root):
    members, conversations = _built(spark, root)
    general = _messages(spark, root).where((F.col("subject_key") != "") & ((F.length("subject_key") < 8) | F.col("subject_key").isin(*C.GENERAL)))
    return C.judgement(C.report(members, conversations, general))


@query(f"""with {_GRAPH} select 'to_check' as "group", conversation_id from x where confidence < 0.7 or warned union all select 'headers', conversation_id from x where method = 'headers' union all select 'fallback', conversation_id from x where method = 'subject_participants_date'
 union all select 'isolated', conversation_id from x where message_count = 1 union all select 'warnings', conversation_id from x where warned union all (select 'long', conversation_id from x order by message_count desc, conversation_id limit 20)""")
def conv_groups(spark, root):
    return C.groups(_built(spark, root)[1])


@query(f"""with {_GRAPH}, t as (select conversation_id, coalesce(string_agg(own, '|' order by own), '') as ids, string_agg(coalesce(message_hash, ''), '|' order by coalesce(message_hash, '')) as hashes, arg_max(subject_key, (ts, m.id)) as subject, min(ts) as first from m join v on v.id = m.id group by 1),
 p as (select conversation_id, coalesce(string_agg(distinct q, '|' order by q), '') as people from (select conversation_id, unnest(case when len(people) = 0 then [null] else people end) as q from m join v on v.id = m.id) group by 1)
 select t.conversation_id, sha256(case when ids <> '' then 'message-ids|' || ids || '|message-hashes|' || hashes else 'fallback|' || coalesce(subject, '') || '|' || strftime(first, '%Y-%m-%d') || '|' || people || '|message-hashes|' || hashes end) as key from t join p on p.conversation_id = t.conversation_id""")
def conv_key(spark, root):
    m = _messages(spark, root)
    return C.stable_key_or_fallback(m.join(C.reconstruct(m), "id"))


@query(f"""with {_GRAPH}, t as (select v.conversation_id, e.id, row_number() over (partition by v.conversation_id order by imported_at, e.id) - 1 as position, {_ends('body_plain')} as b from v join emails e on e.id = v.id),
 q as (select conversation_id, b, min(position) as position from t where b <> '' group by 1, 2), j as (select conversation_id, string_agg(b, chr(10) || chr(10) order by position) as text from q group by 1),
 a as (select conversation_id, arg_max(subject_key, (ts, m.id)) as subject from m join v on v.id = m.id group by 1)
 select a.conversation_id, length(substring(subject || chr(10) || chr(10) || coalesce(text, ''), 1, 50000)) as chars, md5(substring(subject || chr(10) || chr(10) || coalesce(text, ''), 1, 50000)) as analysis_md5 from a left join j on j.conversation_id = a.conversation_id""")
def conv_analysis(spark, root):
    m = _messages(spark, root)
    members = C.reconstruct(m)
    e = table(spark, root, "emails").select("id", F.col("imported_at").alias("at"), F.col("body_plain").alias("body")).join(members, "id")
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("conversation_id").orderBy("at", "id")) - 1)
    subjects = m.join(members, "id").groupBy("conversation_id").agg(F.max_by("subject_key", F.struct("at", "id")).alias("subject"))
    return C.analysis_text(e, subjects).select("conversation_id", F.length("analysis").cast("long").alias("chars"), F.md5("analysis").alias("analysis_md5"))


@query(f"""with {_GRAPH}, t as (select email_id as id, arg_max(struct_pack(b := body_current_message_clean, q := quoted_thread_text), id) as r from clean_texts group by 1)
 select v.conversation_id, row_number() over (partition by v.conversation_id order by imported_at, e.id) - 1 as position, e.id, v.relation, md5(substring(coalesce(t.r.b, e.body_plain, ''), 1, 1200)) as preview_md5, length(substring(coalesce(t.r.q, ''), 1, 1200)) as quoted_chars
 from v join emails e on e.id = v.id left join t on t.id = e.id""")
def conv_detail(spark, root):
    c = latest(table(spark, root, "clean_texts").select(F.col("email_id").alias("id"), F.col("id").alias("n"), "body_current_message_clean", "quoted_thread_text"), ["id"], ["n"])
    e = table(spark, root, "emails").select("id", "imported_at", "body_plain").join(C.reconstruct(_messages(spark, root)), "id").join(c, "id", "left")
    preview = F.substring(F.coalesce("body_current_message_clean", "body_plain", F.lit("")), 1, 1200)
    position = F.row_number().over(Window.partitionBy("conversation_id").orderBy("imported_at", "id")) - 1
    return e.select("conversation_id", position.cast("long").alias("position"), "id", "relation", F.md5(preview).alias("preview_md5"), F.length(F.substring(F.coalesce("quoted_thread_text", F.lit("")), 1, 1200)).cast("long").alias("quoted_chars"))
