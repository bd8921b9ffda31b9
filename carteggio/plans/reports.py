"""Queries of diagnostics, labels, entities, graphs and report counters, each beside the SQL of the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from carteggio.functions import text as T
from carteggio.operators import diagnostics, discovery
from carteggio.operators import conversations as C
from carteggio.operators.relational import latest, top_k
from carteggio.plans import conversations as P
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


# --- measures of a clustering; every thirteenth vector stands for noise, probabilities for what a model would give

_ASSIGNED = "a as (select vec_id, embedding, case when vec_id % 13 = 0 then -1 else label end as cluster_id, (vec_id % 10)::double / 10 as probability from embeddings)"


def _assigned(spark, root):
    e = table(spark, root, "embeddings")
    return e.select("vec_id", "embedding", F.when(F.col("vec_id") % 13 == 0, -1).otherwise(F.col("label")).alias("cluster_id"), (F.col("vec_id") % 10 / 10.0).alias("probability"))


_METRICS = f"""{_ASSIGNED}, s as (select cluster_id, count(*) as n from a where cluster_id <> -1 group by 1), m as (select (select count(*) from a) as total, count(*) as clusters, (select count(*) from a where cluster_id = -1) as noise, max(n) as max_size, min(n) as min_size,
 median(n) as median_size, avg(n) as mean_size, count(*) filter (n < 4) as small_clusters, (select avg(probability) from a where cluster_id <> -1)::double as mean_probability, (select count(*) from a where cluster_id <> -1 and probability < 0.5) as low_confidence,
 count(*) filter (n > (select count(*) from a) * 0.25) as large_clusters from s)"""


@query(f"with {_METRICS} select *, noise / total as noise_ratio, max_size / total as largest_ratio from m")
def cluster_metrics(spark, root):
    m = diagnostics.metrics(_assigned(spark, root))
    return m.select(*[F.round(c, 9).alias(c) if c in ("mean_size", "mean_probability", "noise_ratio", "largest_ratio") else F.col(c) for c in m.columns])


@query(f"""with {_METRICS} select array_to_string(list_filter([case when max_size / total > 0.05 then 'dominant_cluster' end, case when noise / total > 0.01 then 'much_noise' end, case when clusters < 3 then 'few_clusters' end,
 case when small_clusters > clusters / 2 then 'many_small_clusters' end, case when mean_probability < 0.5 then 'low_probability' end, case when total < 20 then 'small_sample' end], lambda x: x is not null), ',') as warnings from m""")
def cluster_warnings(spark, root):
    return diagnostics.warnings(diagnostics.metrics(_assigned(spark, root)), 0.01, 0.05).select(F.array_join("warnings", ",").alias("warnings"))


@query("select row_number() over (order by model_name, dimension) as id, model_name, null::varchar as version, dimension from (select distinct model_name, len(embedding)::int as dimension from atlas_embedding_cache where embedding is not null)")
def model_registry(spark, root):
    cache = table(spark, root, "atlas_embedding_cache").where("embedding is not null").select("model_name", F.lit(None).cast("string").alias("version"), F.size("embedding").alias("dimension"))
    none = spark.createDataFrame([], "id long, model_name string, version string, dimension int")
    return diagnostics.register_models(none, cache)


@query()
def vec_split(spark, root):
    return diagnostics.split_suggestions(table(spark, root, "embeddings"), "vec_id", "label", "embedding")


# --- keywords and labels

_STOP = [w for t in T.TELLING.values() for w in t]
_GRAMS = "d as (select doc_id, source, list_filter(regexp_extract_all(lower(text), '([a-zà-öø-ÿ]{3,})', 1), lambda x: x not in (" + ", ".join(f"'{w}'" for w in _STOP) + """)) as w from documents where text is not null and source is not null),
 g as (select source, doc_id, w[i] as term from (select *, unnest(range(1, len(w) + 1)) as i from d) union all select source, doc_id, w[i] || ' ' || w[i + 1] from (select *, unnest(range(1, len(w))) as i from d) union all select source, doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from (select *, unnest(range(1, len(w) - 1)) as i from d)),
 c as (select source, doc_id, term, count(*) as tf from g group by 1, 2, 3), t as (select source, term, sum(tf) as freq, count(*) as df from c group by 1, 2), k as (select * from (select *, row_number() over (partition by source order by freq desc, term) as rk from t) where rk <= 80),
 z as (select source, count(*) as size from d group by 1), x as (select c.source, c.doc_id, c.term, z.size, (1 + ln(tf)) * (ln((1 + size) / (1 + df)) + 1) as w from c join k on k.source = c.source and k.term = c.term join z on z.source = c.source),
 u as (select source, term, size, w / sqrt(sum(w * w) over (partition by source, doc_id)) as w from x), s as (select source, term, sum(w) / max(size) as score from u group by 1, 2),
 r as (select source, term, round(score, 6) as score, row_number() over (partition by source order by round(score, 9) desc, term) as rank from s)"""


def _keywords(spark, root):
    docs = table(spark, root, "documents").where("text is not null and source is not null")
    return docs, diagnostics.group_keywords(docs, "doc_id", "source", T.words(F.col("text"), 3), _STOP)


@query(f"with {_GRAMS} select * from r where rank <= 10")
def source_keywords(spark, root):
    return _keywords(spark, root)[1].withColumn("score", F.round("score", 6))


@query(f"""with {_GRAMS}, l as (select source, list(term order by rank) as c from r where rank <= 4 group by 1),
 f as (select source, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda y: contains(y, x[1]) or contains(x[1], y))) > 0 then acc else list_concat(acc, x) end) as c from l)
 select z.source, case when len(c) > 0 then array_to_string(c[1:3], ', ') else 'Cluster ' || z.source end as label, round(least(1.0, size / 10) * case when len(c) >= 2 then 1.0 else 0.5 end, 3) as confidence from z left join f on f.source = z.source""")
def source_labels(spark, root):
    docs, words = _keywords(spark, root)
    return diagnostics.labels(words, words.where("false"), docs.groupBy("source").agg(F.count("*").alias("size")), "source")


@query("""select source, lang, confidence, covered, size from (select source, lang, round(avg(coalesce(c, 0)), 2) as confidence, count(*) as covered, sum(count(*)) over (partition by source)::bigint as size, row_number() over (partition by source order by count(*) desc, lang) as rk
 from (select source, coalesce(nullif(lang, ''), 'Da definire') as lang, n_chars / 1000.0 as c from documents) group by source, lang) where rk = 1""")
def group_majority(spark, root):
    d = table(spark, root, "documents").select("source", "lang", (F.col("n_chars") / 1000.0).alias("c"))
    return diagnostics.majority(d, "source", "lang", "c").select("source", "lang", "confidence", "covered", "size")


@query()
def topic_discovery(spark, root):
    return diagnostics.topics(table(spark, root, "documents").where("text is not null"), "doc_id", T.words(F.col("text"), 3))


@query("""with w as (select doc_id, source, unnest(list_filter(regexp_extract_all(lower(text), '([a-zà-öø-ÿ][a-zà-öø-ÿ0-9]{2,})', 1), lambda x: x not in ('bcc', 'cc', 'come', 'data', 'date', 'from', 'message', 'sent', 'subject', 'to', 'your'))) as t from documents where text is not null and source is not null),
 c as (select source, t, count(*) as n from w group by 1, 2) select source, t as term, n, rk from (select *, row_number() over (partition by source order by n desc, t) as rk from c) where rk <= 8""")
def topic_terms(spark, root):
    from carteggio.functions.cleaning import HEADER_WORDS

    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ][a-zà-öø-ÿ0-9]{2,})"), 1), lambda x: ~x.isin(*HEADER_WORDS))
    d = table(spark, root, "documents").where("text is not null and source is not null").select("source", F.explode(w).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    return top_k(d, ["source"], [F.col("n").desc(), F.col("term")], 8, "rk")


# --- entities, graph, search

_DOMAIN = "regexp_extract(lower(sender), '@([a-z0-9.-]+)', 1)"


@query(f"""with l as (select split_part({_DOMAIN}, '.', 1) as label from emails where contains(sender, '@')), n as (select case when label in ('gmail', 'outlook', 'hotmail', 'yahoo') then '' else array_to_string(list_transform(string_split(replace(label, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as entity from l)
 select entity, count(*) as n from n group by 1""")
def domain_entities(spark, root):
    e = table(spark, root, "emails").where(F.col("sender").contains("@"))
    return e.groupBy(discovery.entity_of_domain(F.regexp_extract(F.lower("sender"), r"@([a-z0-9.-]+)", 1)).alias("entity")).agg(F.count("*").alias("n"))


@query(r"""with e as (select id, lower(trim(display_name)) as name, regexp_extract(lower(trim(display_name)), '[\pL\pN_]+') as w from atlas_entities), t as (select id, lower(content) as t from atlas_semantic_documents where content is not null), v as (select id, unnest(list_distinct(regexp_extract_all(t, '([\pL\pN_]+)', 1))) as w from t)
 select e.id as entity, count(*) as documents, min(t.id) as first_document from e join v on v.w = e.w join t on t.id = v.id where contains(t, name) and regexp_matches(t, '(?:^|[^\pL\pN_])' || regexp_replace(name, '([\\.\[\]{}()*+?^$|\-])', '\\\1', 'g') || '(?:$|[^\pL\pN_])') group by 1""")
def dictionary_mentions(spark, root):
    m = discovery.mentions(table(spark, root, "atlas_semantic_documents"), "id", "content", table(spark, root, "atlas_entities").select(F.col("id").alias("entity"), "display_name"), "entity", "display_name")
    return m.groupBy("entity").agg(F.count("*").alias("documents"), F.min("id").alias("first_document"))


@query("select id, array_to_string(list_filter(regexp_extract_all(lower(subject), '([a-zà-öø-ÿ]{4,})', 1), lambda x: x not in ('pratica', 'della', 'dello'))[1:3], ' ') as signals from emails where subject is not null")
def text_subject_signals(spark, root):
    signals = F.slice(F.filter(T.words(F.col("subject"), 4), lambda x: ~x.isin("pratica", "della", "dello")), 1, 3)
    return table(spark, root, "emails").where("subject is not null").select("id", F.array_join(signals, " ").alias("signals"))


@query("select distinct source, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from documents where source is not null")
def text_slug(spark, root):
    return table(spark, root, "documents").where("source is not null").select("source", discovery.slug(F.col("source")).alias("slug")).distinct()


_EDGES = """g as (select distinct 'domain:' || unnest(regexp_extract_all(lower(sender), '@([a-z0-9.-]+[a-z0-9])', 1)) as source, 'item:' || id as target, 'domain_to_item' as edge_type from emails where sender is not null
 union all select distinct 'person:' || lower(unnest(coalesce(from_json(try_cast(recipients as json), '["VARCHAR"]'), []))), 'item:' || id, 'person_to_item' from emails), e as (select * from g where source <> 'person:')"""


def _edges(spark, root):
    to = F.coalesce(F.from_json("recipients", "array<string>"), F.array().cast("array<string>"))
    return discovery.graph(table(spark, root, "emails"), "id", {"domain": T.domains(F.coalesce("sender", F.lit(""))), "person": F.transform(to, F.lower)})


@query(f"with {_EDGES} select * from e")
def graph_edges(spark, root):
    return _edges(spark, root)


@query(f"with {_EDGES} select source as node_id, split_part(source, ':', 1) as node_type, count(*) as frequency from e group by 1")
def graph_node_sizes(spark, root):
    return discovery.nodes(_edges(spark, root))


@query("""with t as (select doc_id, text, instr(' ' || regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', ' ', 'g') || ' ', ' quantita ') as p from documents where text is not null), u as (select *, greatest(p - 60, 1) as a from t where p > 0)
 select doc_id, regexp_replace(case when a > 1 then '… ' else '' end || substring(text, a, p - a) || '[' || substring(text, p, 8) || ']' || substring(text, p + 8, 60) || case when p + 68 <= length(text) then ' …' else '' end, '\\s+', ' ', 'g') as evidence from u""")
def search_snippets(spark, root):
    return table(spark, root, "documents").select("doc_id", discovery.snippet(F.col("text"), "quantita").alias("evidence")).where("evidence is not null")


# --- counters and exports


@query("""select count(*) as emails, count(distinct year(imported_at)) as years, count(distinct regexp_extract(lower(sender), '@([a-z0-9.-]+)', 1)) filter (contains(sender, '@')) as domains, count(*) filter (exists (select 1 from own_accounts a where contains(lower(coalesce(sender, '')), a.address))) as sent,
 count(*) filter (regexp_matches(lower(coalesce(subject, '')), 'newsletter|unsubscribe|no-?reply')) as noise_marked, count(*) filter (has_attachments = 1) as with_attachments from emails""")
def study_counters(spark, root):
    own = table(spark, root, "own_accounts").agg(F.collect_set("address").alias("own"))  # the studio's own mailboxes: one row
    e = table(spark, root, "emails").select("sender", "subject", "imported_at", "has_attachments").crossJoin(F.broadcast(own))
    low = F.lower(F.coalesce("sender", F.lit("")))
    return e.agg(
        F.count("*").alias("emails"), F.countDistinct(F.year("imported_at")).alias("years"), F.countDistinct(F.when(F.col("sender").contains("@"), F.regexp_extract(low, r"@([a-z0-9.-]+)", 1))).alias("domains"),
        F.count_if(F.exists("own", lambda a: low.contains(a))).alias("sent"), F.count_if(F.lower(F.coalesce("subject", F.lit(""))).rlike("newsletter|unsubscribe|no-?reply")).alias("noise_marked"), F.count_if(F.col("has_attachments") == 1).alias("with_attachments"),
    )


@query("""with l as (select email_id, arg_max(struct_pack(m := message_type, q := quality_score, x := excluded_from_main_clustering), id) as r from clean_texts group by 1)
 select count(*) as cleaned, count(*) filter (r.x = 1) as excluded, count(*) filter (r.m = 'newsletter') * 1.0 / count(*) > 0.2 as many_newsletters, count(*) filter (r.q < 0.55) as low_quality, (select count(*) from emails where id not in (select email_id from clean_texts)) as without_text from l""")
def review_counters(spark, root):
    c = latest(table(spark, root, "clean_texts").select("email_id", "id", "message_type", "quality_score", "excluded_from_main_clustering"), ["email_id"], ["id"])
    n = c.agg(F.count("*").alias("cleaned"), F.count_if(F.col("excluded_from_main_clustering") == 1).alias("excluded"), (F.count_if(F.col("message_type") == "newsletter") / F.count("*") > 0.2).alias("many_newsletters"), F.count_if(F.col("quality_score") < 0.55).alias("low_quality"))
    without = table(spark, root, "emails").select(F.col("id").alias("email_id")).join(table(spark, root, "clean_texts").select("email_id"), "email_id", "left_anti").agg(F.count("*").alias("without_text"))
    return n.crossJoin(F.broadcast(without))  # one row each


@query("""select source_file_id, count(distinct e.id) as mails, sum(coalesce(c.excluded_from_main_clustering, 0))::bigint as suspicious, round(avg(quality_score), 6) as mean_quality, count(*) filter (message_type = 'operational_email') as operational from emails e left join clean_texts c on c.email_id = e.id group by 1""")
def area_rollup(spark, root):
    c = table(spark, root, "clean_texts").select(F.col("email_id").alias("id"), "excluded_from_main_clustering", "quality_score", "message_type")
    e = table(spark, root, "emails").select("id", "source_file_id").join(c, "id", "left")
    return e.groupBy("source_file_id").agg(
        F.countDistinct("id").alias("mails"), F.sum(F.coalesce("excluded_from_main_clustering", F.lit(0)).cast("long")).alias("suspicious"), F.round(F.avg("quality_score"), 6).alias("mean_quality"), F.count_if(F.col("message_type") == "operational_email").alias("operational"),
    )


@query("""with g as (select source_file_id, regexp_extract(lower(sender), '@([a-z0-9.-]+)', 1) as sender, count(*) as n from emails where contains(sender, '@') group by 1, 2), x as (select *, row_number() over (partition by source_file_id order by n desc, sender) as rk from g),
 i as (select source_file_id, id, row_number() over (partition by source_file_id order by id) as rk from emails) select s.source_file_id, s.senders, j.examples from (select source_file_id, string_agg(sender || ' (' || n || ')', '; ' order by rk) as senders from x where rk <= 5 group by 1) s
 join (select source_file_id, string_agg(cast(id as varchar), ' ' order by rk) as examples from i where rk <= 5 group by 1) j on j.source_file_id = s.source_file_id""")
def context_report(spark, root):
    e = table(spark, root, "emails")
    n = e.where(F.col("sender").contains("@")).groupBy("source_file_id", F.regexp_extract(F.lower("sender"), r"@([a-z0-9.-]+)", 1).alias("s")).agg(F.count("*").alias("n"))
    joined = lambda df, v, name, sep: df.groupBy("source_file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", v.alias("v")))), lambda x: x["v"]), sep).alias(name))
    senders = joined(top_k(n, ["source_file_id"], [F.col("n").desc(), F.col("s")], 5), F.concat("s", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), "senders", "; ")
    examples = joined(top_k(e.select("source_file_id", "id"), ["source_file_id"], [F.col("id")], 5), F.col("id").cast("string"), "examples", " ")
    return senders.join(examples, "source_file_id")


@query("""with r as (select label, vec_id, row_number() over (partition by label order by vec_id) as position from embeddings), c as (select label, count(*) as size from embeddings group by 1)
 select r.label, r.position, r.vec_id, c.size, round(c.size * 100.0 / (select count(*) from embeddings), 2) as percent from r join c on c.label = r.label where position <= 5""")
def cluster_review(spark, root):
    e = table(spark, root, "embeddings")
    stored = top_k(e.select("label", "vec_id"), ["label"], [F.col("vec_id")], 5, "position")
    sizes = e.groupBy("label").agg(F.count("*").alias("size"))
    total = e.agg(F.count("*").alias("total"))
    return stored.join(sizes, "label").crossJoin(F.broadcast(total)).select("label", "position", "vec_id", "size", F.round(F.col("size") * 100 / F.col("total"), 2).alias("percent"))  # one row


@query("""select r.pos, e.id, e.message_hash from (select id, row_number() over (order by id desc) as pos from emails where has_attachments = 1) r join emails e on e.id = r.id""")
def requested_messages(spark, root):
    from pyspark.sql import Window

    e = table(spark, root, "emails")
    # the newest mails with attachments, asked for by id: a list given by a user, so small
    ids = e.where("has_attachments = 1").select("id", F.row_number().over(Window.orderBy(F.col("id").desc())).alias("pos"))
    return discovery.requested(e.select("id", "message_hash"), "id", ids).select("pos", "id", "message_hash")


_EXPORT = f"""{P._GRAPH}, b as (select v.conversation_id, e.id, e.imported_at as ts, e.sender, e.has_attachments, m.subject_key, m.people, exists (select 1 from own_accounts a where contains(lower(coalesce(e.sender, '')), a.address)) as o from v join emails e on e.id = v.id join m on m.id = v.id),
 f as (select conversation_id, arg_max(subject_key, (ts, id)) as subject, min(ts) as date_start, max(ts) as date_end, count(*) as message_count, count(*) filter (not o) as incoming_count, count(*) filter (o) as outgoing_count, sum(has_attachments)::bigint as attachment_count from b group by 1),
 q as (select conversation_id, count(distinct p) as participants_count from (select conversation_id, unnest(people) as p from b) group by 1), u2 as (select conversation_id, string_agg(distinct d, ',' order by d) as domains from (select conversation_id, unnest(regexp_extract_all(lower(coalesce(sender, '')), '@([a-z0-9.-]+[a-z0-9])', 1)) as d from b) group by 1)
 select f.*, year(date_start)::int as year, month(date_start)::int as month, coalesce(participants_count, 0) as participants_count, coalesce(domains, '') as sender_domains, coalesce(split_part(domains, ',', 1), '') as main_domain, x.method, x.confidence from f join x on x.conversation_id = f.conversation_id left join q on q.conversation_id = f.conversation_id left join u2 on u2.conversation_id = f.conversation_id"""


@query(f"with {_EXPORT}")
def conversation_export(spark, root):
    own = table(spark, root, "own_accounts").agg(F.collect_set("address").alias("own"))  # one row
    m = P._messages(spark, root)
    members = C.reconstruct(m)
    e = table(spark, root, "emails").select("id", "sender", "has_attachments").crossJoin(F.broadcast(own))
    low = F.lower(F.coalesce("sender", F.lit("")))
    b = m.select("id", "at", "subject_key", "participants").join(e, "id").join(members, "id").select(
        "conversation_id", "id", "at", "subject_key", "participants", "has_attachments", F.exists("own", lambda a: low.contains(a)).alias("o"), T.domains(low).alias("d"),
    )
    f = b.groupBy("conversation_id").agg(
        F.max_by("subject_key", F.struct("at", "id")).alias("subject"), F.min("at").alias("date_start"), F.max("at").alias("date_end"), F.count("*").alias("message_count"), F.count_if(~F.col("o")).alias("incoming_count"),
        F.count_if("o").alias("outgoing_count"), F.sum(F.col("has_attachments").cast("long")).alias("attachment_count"),
    )
    people = b.select("conversation_id", F.explode("participants").alias("p")).groupBy("conversation_id").agg(F.countDistinct("p").alias("n"))
    domains = b.select("conversation_id", F.explode("d").alias("d")).groupBy("conversation_id").agg(F.array_sort(F.collect_set("d")).alias("ds"))
    graded = C.graded(members)
    out = f.join(people, "conversation_id", "left").join(domains, "conversation_id", "left").join(graded, "conversation_id")
    none = F.array().cast("array<string>")
    return out.select(
        *f.columns, F.year("date_start").alias("year"), F.month("date_start").alias("month"), F.coalesce("n", F.lit(0)).alias("participants_count"), F.array_join(F.coalesce("ds", none), ",").alias("sender_domains"),
        F.coalesce(F.get("ds", F.lit(0)), F.lit("")).alias("main_domain"), "method", "confidence",
    )
