"""Queries over conversations, texts, terms and vectors, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carteggio.functions import text as T
from carteggio.operators import conversations as C
from carteggio.operators import graph, terms, timestamps
from carteggio.operators import relational as R
from carteggio.operators import vectors as V
from carteggio.operators.nearest import nearest
from carteggio.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WORDS = "regexp_extract_all(lower({c}), '([a-zà-öø-ÿ]{{{n},}})', 1)"
_SUBJECT = r"lower(trim(regexp_replace(regexp_replace(coalesce(subject, ''), '^\s*(?:(?:re|r|rif|aw|wg|fw|fwd|i|tr|rv)\s*:\s*)+', '', 'i'), '\s+', ' ', 'g')))"
_PARTS = "list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', sender, recipients)), '([a-z0-9._%+-]+@[a-z0-9.-]+[a-z0-9])', 1)))"
_LINKS = f"""m as (select id, {_SUBJECT} as subject_key, imported_at as sent, {_PARTS} as p from emails),
 l as (select id, subject_key, sent, lag(id) over w as previous, coalesce(abs(floor((epoch_us(sent) - epoch_us(lag(sent) over w)) / 86400000000)) <= 45 and list_has_any(p, lag(p) over w), false) as linked
       from m where length(subject_key) >= 8 and subject_key not in ('documenti','richiesta','aggiornamento','comunicazione','informazioni','documents','request','update') window w as (partition by subject_key order by sent, id)),
 i as (select id, subject_key, min(id) over (partition by subject_key, chain) as conversation_id from (select *, sum((not linked)::int) over (partition by subject_key order by sent, id rows unbounded preceding) as chain from l))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _messages(spark, root):
    e = table(spark, root, "emails").select("id", "subject", F.col("imported_at").alias("at"), "has_attachments", "sender", "recipients")
    return e.join(C.participants(e), "id")


# --- conversations


@query(f"select id, array_to_string({_PARTS}, ',') as participants from emails")
def conv_participants(spark, root):
    return C.participants(table(spark, root, "emails")).select("id", F.array_join("participants", ",").alias("participants"))


@query("""select id, exists (select 1 from own_accounts a where contains(lower(coalesce(sender, '')), a.address)) as outgoing from emails""")
def conv_direction(spark, root):
    own = table(spark, root, "own_accounts").agg(F.collect_set("address").alias("own"))  # the studio's own mailboxes: one row
    return table(spark, root, "emails").select("id", "sender").crossJoin(F.broadcast(own)).select("id", F.exists("own", lambda a: F.lower(F.coalesce("sender", F.lit(""))).contains(a)).alias("outgoing"))


@query(f"with {_LINKS} select id, subject_key, previous, linked from l")
def conv_subject_links(spark, root):
    return C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH).drop("at")


@query(f"with {_LINKS} select id, conversation_id from i")
def conv_islands(spark, root):
    return C.islands(C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH))


@query(f"with {_LINKS} select id as node, conversation_id as component from i where id <> conversation_id")
def conv_components(spark, root):
    links = C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH).where("linked")
    return graph.connected_components(links.select(F.col("id").alias("src"), F.col("previous").alias("dst")))


def _folded(spark, root):
    m = _messages(spark, root).join(C.islands(C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH)), "id")
    return m.withColumn("outgoing", F.lower(F.coalesce("sender", F.lit(""))).contains("@valdoria-studio.example"))


@query(f"""with {_LINKS}, x as (select e.*, i.conversation_id, contains(lower(coalesce(sender, '')), '@valdoria-studio.example') as o, {_PARTS} as p from emails e join i on i.id = e.id)
 select x.conversation_id, count(*) as message_count, count(*) filter (o) as outgoing, count(*) filter (not o) as incoming, sum(has_attachments)::bigint as with_attachments, min(imported_at) as first_at,
 max(imported_at) as last_at, arg_max(subject, (imported_at, id)) as last_subject, any_value(q.participants) as participants from x join (select conversation_id, coalesce(string_agg(distinct u, ',' order by u), '') as participants
 from (select conversation_id, unnest(case when len(p) = 0 then [null] else p end) as u from x) group by 1) q on q.conversation_id = x.conversation_id group by 1""")
def conv_fold(spark, root):
    return C.fold(_folded(spark, root))


@query(f"with {_LINKS} select conversation_id, count(*) as n, min(id) as first_id, max(id) as last_id from i group by 1 order by n desc, conversation_id limit 10")
def conv_longest(spark, root):
    i = C.islands(C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH))
    return i.groupBy("conversation_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).orderBy(F.col("n").desc(), "conversation_id").limit(10)


@query(f"with {_LINKS} select i.id, conversation_id, row_number() over (partition by conversation_id order by imported_at, i.id) - 1 as position from i join emails e on e.id = i.id")
def conv_positions(spark, root):
    m = C.islands(C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH)).join(table(spark, root, "emails").select("id", "imported_at"), "id")
    return terms.positions(m, "conversation_id", [F.col("imported_at"), F.col("id")]).select("id", "conversation_id", F.col("position").cast("long"))


@query(f"""with {_LINKS}, t as (select conversation_id, e.id, regexp_replace(body_plain, '^\\s+|\\s+$', '', 'g') as b from i join emails e on e.id = i.id where body_plain is not null),
 o as (select conversation_id, b, min(id) as id from t where b <> '' group by 1, 2) select conversation_id, count(*) as parts, sha256(string_agg(b, chr(10) || chr(10) order by id)) as text_hash from o group by 1""")
def conv_unique_text(spark, root):
    m = C.islands(C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH)).join(table(spark, root, "emails").select("id", "body_plain"), "id")
    return C.unique_text(m, "conversation_id", "id", "body_plain").select("conversation_id", "parts", F.sha2("text", 256).alias("text_hash"))


@query(f"""with {_LINKS}, k as (select conversation_id, string_agg(distinct message_hash, '|' order by message_hash) as h, string_agg(distinct cast(e.id as varchar), '|' order by cast(e.id as varchar)) as s from i join emails e on e.id = i.id group by 1)
 select conversation_id, sha256(h || '#' || s) as key from k""")
def conv_stable_key(spark, root):
    m = C.islands(C.subject_links(_messages(spark, root), general=C.GENERAL + C.GENERAL_ENGLISH)).join(table(spark, root, "emails").select("id", "message_hash"), "id")
    return C.stable_key(m.withColumn("sid", F.col("id").cast("string")), "conversation_id", "message_hash", "sid")


@query("""with own as (select lower(regexp_replace(original_message_id, '[<>\\s]+', '', 'g')) as mid, max(id) as target from emails where original_message_id is not null group by 1),
 r as (select distinct id, lower(regexp_replace(unnest(regexp_extract_all(try_cast(raw_headers_json as json) ->> '$.References', '<([^<>]+)>', 1)), '[<>\\s]+', '', 'g')) as mid from emails)
 select r.id, r.mid, own.target from r left join own on own.mid = r.mid""")
def reference_resolution(spark, root):
    clean = lambda c: F.lower(F.regexp_replace(c, r"[<>\s]+", ""))
    e = table(spark, root, "emails")
    own = e.where("original_message_id is not null").groupBy(clean("original_message_id").alias("mid")).agg(F.max("id").alias("target"))
    # the path reads valid JSON only, so headers that were cut off are none
    refs = F.from_json("raw_headers_json", "map<string,string>")["References"]
    cited = e.select("id", F.explode(F.regexp_extract_all(refs, F.lit("<([^<>]+)>"), 1)).alias("m")).select("id", clean(F.col("m")).alias("mid")).distinct()
    return cited.join(own, "mid", "left").select("id", "mid", "target")


@query(r"""select id, coalesce(nullif(lower(regexp_extract(coalesce(try_cast(raw_headers_json as json) ->> '$.References', ''), '<([^<>\s]+)>', 1)), ''), """ + _SUBJECT + ") as legacy_key from emails")
def legacy_thread_key(spark, root):
    refs = F.coalesce(F.from_json("raw_headers_json", "map<string,string>")["References"], F.lit(""))
    return table(spark, root, "emails").select("id", F.coalesce(F.nullif(F.lower(F.regexp_extract(refs, r"<([^<>\s]+)>", 1)), F.lit("")), T.subject(F.col("subject"))).alias("legacy_key"))


# --- texts


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t' || chr(160) || ']+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as clean_md5 from documents where text is not null""")
def text_whitespace(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.md5(T.whitespace(F.col("text"))).alias("clean_md5"))


@query(f"select id, {_SUBJECT} as subject_clean from emails")
def text_subject(spark, root):
    return table(spark, root, "emails").select("id", T.subject(F.col("subject")).alias("subject_clean"))


@query(r"""with x as (select doc_id, text, """ + _WORDS.format(c="text", n=2) + r""" as w from documents where text is not null)
 select doc_id, len(w) as words, len(list_distinct(w)) as different, round(0.4 * least(length(text) / 400.0, 1.0) + 0.4 * least(len(list_distinct(w)) / 50.0, 1.0) + 0.2 * case when len(w) > 0 then len(list_distinct(w))::double / len(w) else 0 end, 6) as quality from x""")
def text_quality(spark, root):
    w = T.words(F.col("text"))
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("different"), F.round(T.quality(F.col("text")), 6).alias("quality"))


_SCORES = ", ".join("{'n': -len(list_filter(w, lambda x: x in (%s))), 'code': '%s'}" % (", ".join(f"'{x}'" for x in t), c) for c, t in sorted(T.TELLING.items()))


@query("with x as (select doc_id, " + _WORDS.format(c="text", n=2) + f" as w from documents where text is not null), y as (select doc_id, list_min([{_SCORES}]) as b from x) select doc_id, case when b.n < 0 then b.code end as language from y")
def text_language(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", T.language(F.col("text")).alias("language"))


@query("""with x as (select id, content, length(content) as n from atlas_semantic_documents where length(content) > 0), y as (select id, content, unnest(range(0, greatest(ceil((n - 2000) / 1800.0), 0)::bigint + 1)) as chunk from x)
 select id, chunk, md5(substring(content, (chunk * 1800 + 1)::bigint, 2000)) as chunk_md5 from y""")
def text_chunks(spark, root):
    docs = table(spark, root, "atlas_semantic_documents").where("length(content) > 0")
    return docs.select("id", F.posexplode(T.chunks(F.col("content"))).alias("chunk", "t")).select("id", F.col("chunk").cast("long"), F.md5("t").alias("chunk_md5"))


@query("select domain, count(*) as n, count(distinct id) as messages from (select id, unnest(regexp_extract_all(lower(sender), '@([a-z0-9.-]+[a-z0-9])', 1)) as domain from emails) group by 1")
def text_domains(spark, root):
    return table(spark, root, "emails").select("id", F.explode(T.domains(F.col("sender"))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("id").alias("messages"))



@query(r"""with x as (select id, list_filter(list_transform(string_split(regexp_replace(body_plain, '\r\n?', chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') as l from emails where body_plain is not null),
 y as (select id, l, list_position(list_transform(l, lambda s: starts_with(s, '>') or regexp_matches(s, '^-{3,}.*[0-9A-Za-z_].*-{3,}$') or regexp_matches(s, '(?:ha scritto|wrote|schrieb|a écrit|escribió).*:$')), true) as q,
 list_position(list_transform(l, lambda s: regexp_matches(s, '^(?:--|_{3,})$')), true) as g from x)
 select id, case when coalesce(q, 0) = 0 then 0 else len(l) - q + 1 end as quoted, case when coalesce(g, 0) = 0 or (coalesce(q, 0) > 0 and q < g) then 0 when coalesce(q, 0) > 0 then q - g else len(l) - g + 1 end as signature,
 case when coalesce(q, 0) = 0 and coalesce(g, 0) = 0 then len(l) when coalesce(g, 0) = 0 then q - 1 when coalesce(q, 0) = 0 then g - 1 else least(q, g) - 1 end as current from y""")
def text_segments(spark, root):
    s = table(spark, root, "emails").where("body_plain is not null").select("id", T.segments(F.col("body_plain")).alias("s"))
    return s.select("id", *[F.size(F.col("s")[n]).cast("long").alias(n) for n in ("current", "quoted", "signature")])


@query(r"""with x as (select id, regexp_replace(regexp_replace(body_html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g') as h from emails where body_html is not null),
 y as (select id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as h from x)
 select id, array_to_string(list_filter(list_transform(string_split(regexp_replace(h, '\r\n?', chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) as plain from y""")
def text_html(spark, root):
    return table(spark, root, "emails").where("body_html is not null").select("id", T.html(F.col("body_html")).alias("plain"))


@query(r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^\s\pZ]'))) as sentences from documents where text is not null")
def text_sentences(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("""select id, case when contains(s, 'preventiv') or contains(s, 'offert') then 'offer' when contains(s, 'fattur') or contains(s, 'invoice') then 'invoice' when contains(s, 'sopralluog') or contains(s, 'site visit') then 'visit' else 'other' end as kind
 from (select id, lower(coalesce(subject, '') || ' ' || coalesce(body_plain, '')) as s from emails)""")
def text_first_match(spark, root):
    both = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body_plain", F.lit("")))
    return table(spark, root, "emails").select("id", T.first_match(both, [("offer", ["preventiv", "offert"]), ("invoice", ["fattur", "invoice"]), ("visit", ["sopralluog", "site visit"])], "other").alias("kind"))


@query("select md5 as text_md5, count(*) as copies, min(doc_id) as first_doc from (select doc_id, md5(text) as md5 from documents where text is not null) group by 1 having count(*) > 1")
def text_copies(spark, root):
    return table(spark, root, "documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query()
def crc_buckets(spark, root):
    return table(spark, root, "documents").where("source is not null").select("doc_id", (-2_000_000 - F.crc32(F.encode("source", "utf-8")) % 1_000_000).alias("bucket"))



# --- terms


_COUNTS = "c as (select doc_id, term, count(*) as tf from (select doc_id, unnest(" + _WORDS.format(c="text", n=3) + ") as term from documents where text is not null) group by 1, 2)"


def _counts(spark, root):
    docs = table(spark, root, "documents").where("text is not null")
    return docs, terms.term_counts(docs, "doc_id", T.words(F.col("text"), 3))


@query(f"with {_COUNTS} select term, sum(tf)::bigint as freq, count(*) as doc_freq, array_to_string(list_sort(list(doc_id))[1:10], ',') as examples from c group by 1 order by freq desc, term limit 500")
def terms_top500(spark, root):
    v = terms.vocabulary(_counts(spark, root)[1], "doc_id", 500)
    return v.select("term", "freq", "doc_freq", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


_TFIDF = _COUNTS + """, n as (select count(*) as n from documents where text is not null), s as (select term, sum(tf) as freq, count(*) as df from c group by 1 order by freq desc, term limit 1000),
 w as (select doc_id, c.term, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from c join s on s.term = c.term, n), u as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w)"""


@query(f"with {_TFIDF} select doc_id, term, round(weight, 6) as weight, rk from (select *, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as rk from u) where rk <= 5")
def tfidf_top_terms(spark, root):
    docs, counts = _counts(spark, root)
    w = terms.tfidf(counts, "doc_id", docs.agg(F.count("*").alias("n")), 1000)
    return R.top_k(w, ["doc_id"], [F.round("weight", 9).desc(), F.col("term")], 5, "rk").select("doc_id", "term", F.round("weight", 6).alias("weight"), "rk")


@query(f"""with {_TFIDF}, p as (select a.doc_id as source, b.doc_id as target, sum(a.weight * b.weight) as similarity from u a join u b on a.term = b.term and a.doc_id <> b.doc_id group by 1, 2)
 select source, target, round(similarity, 6) as similarity from (select *, row_number() over (partition by source order by round(similarity, 9) desc, target) as rk from p where similarity > 0) where rk <= 5""")
def similarity_edges(spark, root):
    near = nearest(table(spark, root, "documents"), "doc_id", "text", "[a-zà-öø-ÿ]{3,}", F.lit(True), "lang")
    return near.select("source", "target", F.round("similarity", 6).alias("similarity"))


@query(f"with {_COUNTS}, l as (select doc_id, sum(tf) as len from c group by 1), g as (select count(*) as n, avg(len) as mean from l), h as (select * from c where term in ('impianto', 'fanghi')), d as (select term, count(*) as df from h group by 1)"
       " select h.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from h join d on d.term = h.term join l on l.doc_id = h.doc_id, g group by 1 having count(*) = 2")  # fmt: skip
def bm25_search(spark, root):
    return terms.bm25(_counts(spark, root)[1], "doc_id", ["impianto", "fanghi"]).select("doc_id", F.round("score", 6).alias("score"))



@query("""with m as (select 'm:' || id as a, 'd:' || unnest(list_distinct(regexp_extract_all(lower(sender), '@([a-z0-9.-]+[a-z0-9])', 1))) as b from emails), s as (select 'm:' || id as a, 's:' || source_file_id as b from emails where source_file_id is not null),
 e as (select * from m union all select * from s) select b as node, count(distinct a) as size from e group by 1""")
def graph_nodes(spark, root):
    e = table(spark, root, "emails")
    domains = e.select("id", F.explode(F.array_distinct(T.domains(F.col("sender")))).alias("d")).select("id", F.concat(F.lit("d:"), "d").alias("node"))
    sources = e.where("source_file_id is not null").select("id", F.concat(F.lit("s:"), F.col("source_file_id").cast("string")).alias("node"))
    return domains.unionByName(sources).groupBy("node").agg(F.countDistinct("id").alias("size"))


@query("""select source, lang, doc_type, n, rk from (select *, row_number() over (order by n desc, source, lang, doc_type) as rk from (select source, lang, doc_type, count(*) as n from documents where source is not null and lang is not null and doc_type is not null group by 1, 2, 3)) where rk <= 20""")
def bucket_discovery(spark, root):
    g = table(spark, root, "documents").where("source is not null and lang is not null and doc_type is not null").groupBy("source", "lang", "doc_type").agg(F.count("*").alias("n"))
    best = g.orderBy(F.col("n").desc(), "source", "lang", "doc_type").limit(20)
    return best.withColumn("rk", F.row_number().over(Window.orderBy(F.col("n").desc(), "source", "lang", "doc_type")))  # 20 rows


# --- vectors

_CENTRE = "p as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as dim from embeddings), m as (select label, dim, avg(x) as m from p group by 1, 2), z as (select label, list(m order by dim) as c from m group by 1)"


@query(f"with {_CENTRE} select label, round(list_sum(c), 6) as total, round(sqrt(list_dot_product(c, c)), 6) as norm, (select count(*) from embeddings e where e.label = z.label) as size from z")
def vec_centroids(spark, root):
    c = V.centroids(table(spark, root, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.norm(F.col("centroid")), 6).alias("norm"), "size")


@query(f"with {_CENTRE}, s as (select e.label, vec_id, list_cosine_similarity(embedding::double[], c) as similarity from embeddings e join z on z.label = e.label) select label, vec_id, round(similarity, 6) as similarity, rank from (select *, row_number() over (partition by label order by round(similarity, 9) desc, vec_id) as rank from s) where rank <= 5")
def vec_representatives(spark, root):
    r = V.representatives(table(spark, root, "embeddings"), "vec_id", "label", "embedding")
    return r.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("select a.label, max(n) as size, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as coherence from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id join (select label, count(*) as n from embeddings group by 1) s on s.label = a.label group by 1")
def vec_coherence(spark, root):
    return V.coherence(table(spark, root, "embeddings"), "label", "embedding").select("label", "size", F.round("coherence", 6).alias("coherence"))


@query(f"with {_CENTRE} select a.label as \"left\", b.label as \"right\", round(list_cosine_similarity(a.c, b.c), 6) as similarity from z a join z b on a.label < b.label where list_cosine_similarity(a.c, b.c) >= 0.1")
def vec_close_groups(spark, root):
    return V.close_groups(table(spark, root, "embeddings"), "label", "embedding", 0.1).select("left", "right", F.round("similarity", 6).alias("similarity"))


@query("""with d as (select a.vec_id, a.label, b.label as other, avg(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id group by 1, 2, 3),
 s as (select vec_id, max(case when label = other then d end) as a, min(case when label <> other then d end) as b from d group by 1) select vec_id, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from s""")
def vec_silhouette(spark, root):
    return V.silhouette(table(spark, root, "embeddings"), "vec_id", "label", "embedding").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("""with x as (select label, rk % 2 = 1 as positive, embedding::double[] as e from (select *, row_number() over (partition by label order by vec_id) as rk from embeddings) where rk <= 4), y as (select v.vec_id, x.label, max(case when positive then c end) as p, max(case when not positive then c end) as q
 from (select v.vec_id, x.label, x.positive, list_cosine_similarity(v.embedding::double[], x.e) as c from embeddings v, x) v join (select distinct label from x) x on x.label = v.label group by 1, 2), z as (select vec_id, label, p - greatest(coalesce(q, 0), 0) as score from y)
 select vec_id, label, round(score, 6) as score from (select *, row_number() over (partition by vec_id order by round(score, 9) desc, label) as rk from z where score >= 0.05) where rk = 1""")
def vec_few_shot(spark, root):
    e = table(spark, root, "embeddings")
    # the first four rows of each label stand for what people labelled, two for and two against
    examples = R.top_k(e, ["label"], [F.col("vec_id")], 4).select("label", (F.col("rank") % 2 == 1).alias("positive"), F.col("embedding").alias("example_vector"))
    return V.few_shot(e.select("vec_id", "embedding"), examples, "vec_id", "embedding", 0.05).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""with v as (select label, vec_id % 7 + 1 as w, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as dim from embeddings), m as (select label, dim, sum(w * x) / sum(w) as m from v group by 1, 2) select label, round(sqrt(sum(m * m)), 6) as norm from m group by 1""")
def vec_weighted_mean(spark, root):
    e = table(spark, root, "embeddings")
    return V.centroids(e, "label", "embedding", F.col("vec_id") % 7 + 1).select("label", F.round(V.norm(F.col("centroid")), 6).alias("norm"))


def _ml(spark, root):
    from pyspark.ml.functions import array_to_vector

    return table(spark, root, "embeddings").select("vec_id", array_to_vector(V.unit(V.doubles("embedding"))).alias("features"))


@query()
def vec_kmeans(spark, root):
    from pyspark.ml.clustering import KMeans

    df = _ml(spark, root)
    return KMeans(k=10, seed=42, maxIter=20).fit(df).transform(df).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def vec_pca2d(spark, root):
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    df = _ml(spark, root)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="c").fit(df).transform(df)
    out = PCA(k=2, inputCol="c", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query()
def instants_by_source(spark, root):
    e = timestamps.normalise(table(spark, root, "emails").select("id", "source_file_id", "sent_at", "imported_at"), table(spark, root, "source_files"))
    return e.groupBy("source_file_id").agg(F.count("*").alias("n"), F.count("sent_us").alias("readable"), F.min("sent_us").alias("first_us"), F.max("sent_us").alias("last_us"))


# --- compositions


@query(f"""with {_CENTRE}, a as (select dim, avg(x) as m from p group by 1), g as (select list(m order by dim) as mean from a), s as (select label, count(*) as n from embeddings group by 1),
 d as (select e.label, list_distance(embedding::double[], c) as d from embeddings e join z on z.label = e.label), w as (select label, avg(d) as s, sum(d * d) as w from d group by 1),
 x as (select z.label, z.c, s.n, w.s, w.w, s.n * list_distance(z.c, g.mean) ** 2 as b from z join s on s.label = z.label join w on w.label = z.label, g),
 r as (select i.label, max((i.s + j.s) / list_distance(i.c, j.c)) as r from x i join x j on i.label <> j.label group by 1)
 select round((sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) as calinski_harabasz, round(avg(r), 6) as davies_bouldin from x join r on r.label = x.label""")
def vec_separation(spark, root):
    s = V.separation(table(spark, root, "embeddings"), "label", "embedding")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(f"""with t as (select id, substring('Oggetto: ' || {_SUBJECT} || chr(10) || 'Partecipanti: ' || array_to_string({_PARTS}, ', ') || chr(10) || coalesce(body_plain, ''), 1, 60000) as content from emails)
 select id, length(content) as chars, sha256(content) as content_hash from t""")
def semantic_documents(spark, root):
    e = table(spark, root, "emails")
    m = e.select("id", "subject", "body_plain").join(C.participants(e), "id")
    content = F.substring(F.concat(F.lit("Oggetto: "), T.subject(F.col("subject")), F.lit("\nPartecipanti: "), F.array_join("participants", ", "), F.lit("\n"), F.coalesce("body_plain", F.lit(""))), 1, 60000)
    return m.select("id", content.alias("c")).select("id", F.length("c").cast("long").alias("chars"), F.sha2("c", 256).alias("content_hash"))


@query("""select id, cleaning_version, language, null::double as quality_score from clean_texts where cleaning_version = (select min(cleaning_version) from clean_texts)
 union all select id, cleaning_version, language, quality_score from clean_texts where cleaning_version > (select min(cleaning_version) from clean_texts)""")
def additive_schema(spark, root):
    clean = table(spark, root, "clean_texts")
    oldest = clean.agg(F.min("cleaning_version").alias("oldest"))
    marked = clean.crossJoin(F.broadcast(oldest)).select("id", "cleaning_version", "language", "quality_score", (F.col("cleaning_version") == F.col("oldest")).alias("old"))  # one row
    return marked.where("old").drop("quality_score", "old").unionByName(marked.where("not old").drop("old"), allowMissingColumns=True)


@query("select id, priority from (select id, round((1 - quality_score) * 40 + least(length(body_current_message_clean), 3000) / 100.0, 6) as priority from clean_texts where quality_score is not null and body_current_message_clean is not null) order by priority desc, id limit 1")
def next_by_priority(spark, root):
    c = table(spark, root, "clean_texts").where("quality_score is not null and body_current_message_clean is not null")
    priority = F.round((1 - F.col("quality_score")) * 40 + F.least(F.length("body_current_message_clean"), F.lit(3000)) / 100.0, 6)
    return c.select("id", priority.alias("priority")).orderBy(F.col("priority").desc(), "id").limit(1)


@query("""select e.id, s.path, coalesce(c.language, 'none') as language, substring(coalesce(c.body_current_message_clean, e.body_plain, ''), 1, 500) as summary,
 list_sort(list_distinct(regexp_extract_all(lower(coalesce(e.sender, '')), '@([a-z0-9.-]+[a-z0-9])', 1)))[1] as main_domain from emails e left join source_files s on s.id = e.source_file_id
 left join (select email_id, r.l as language, r.t as body_current_message_clean from (select email_id, arg_max({'l': language, 't': body_current_message_clean}, id) as r from clean_texts group by 1)) c on c.email_id = e.id""")
def wide_export(spark, root):
    c = R.latest(table(spark, root, "clean_texts").select("email_id", "id", "language", "body_current_message_clean"), ["email_id"], ["id"]).select(F.col("email_id").alias("id"), "language", "body_current_message_clean")
    s = table(spark, root, "source_files").select(F.col("id").alias("source_file_id"), "path")
    e = table(spark, root, "emails").select("id", "source_file_id", "sender", "body_plain").join(s, "source_file_id", "left").join(c, "id", "left")
    summary = F.substring(F.coalesce("body_current_message_clean", "body_plain", F.lit("")), 1, 500)
    domain = F.get(F.array_sort(F.array_distinct(T.domains(F.coalesce("sender", F.lit(""))))), F.lit(0))
    return e.select("id", "path", F.coalesce("language", F.lit("none")).alias("language"), summary.alias("summary"), domain.alias("main_domain"))
