"""Queries of the relational operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carteggio.operators import relational as R
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


@query("""select c.email_id, c.id as clean_id, c.cleaning_version, c.language, c.message_type from clean_texts c
          where c.id = (select max(d.id) from clean_texts d where d.email_id = c.email_id)""")
def latest_clean_text(spark, root):
    return R.latest(table(spark, root, "clean_texts").select("email_id", F.col("id").alias("clean_id"), "cleaning_version", "language", "message_type"), ["email_id"], ["clean_id"])


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as last_date from orders group by 1")
def latest_order_per_customer(spark, root):
    last = R.latest(table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return last.withColumnRenamed("o_orderdate", "last_date")


@query("""select e.id, e.project_id, c.id as clean_id, c.message_type from emails e left join clean_texts c on c.email_id = e.id and c.cleaning_version =
          (select max(cleaning_version) from clean_texts)""")
def emails_left_clean(spark, root):
    clean = table(spark, root, "clean_texts").select(F.col("email_id").alias("id"), F.col("id").alias("clean_id"), "message_type", "cleaning_version")
    newest = clean.agg(F.max("cleaning_version").alias("cleaning_version"))
    return table(spark, root, "emails").select("id", "project_id").join(clean.join(newest, "cleaning_version").drop("cleaning_version"), "id", "left")


@query("select e.id, s.path, s.zone_name from emails e join source_files s on s.id = e.source_file_id where e.parse_status = 'ok'")
def emails_with_source(spark, root):
    sources = table(spark, root, "source_files").select(F.col("id").alias("source_file_id"), "path", "zone_name")
    return table(spark, root, "emails").where("parse_status = 'ok'").select("id", "source_file_id").join(sources, "source_file_id").drop("source_file_id")


@query("select e.id, e.project_id from emails e where not exists (select 1 from clean_texts c where c.email_id = e.id)")
def emails_not_cleaned(spark, root):
    done = table(spark, root, "clean_texts").select(F.col("email_id").alias("id"))
    return table(spark, root, "emails").select("id", "project_id").join(done, "id", "left_anti")


@query("select e.id, e.message_hash from emails e where exists (select 1 from clean_texts c where c.email_id = e.id and c.language = 'it')")
def emails_cleaned_semi(spark, root):
    done = table(spark, root, "clean_texts").where("language = 'it'").select(F.col("email_id").alias("id"))
    return table(spark, root, "emails").select("id", "message_hash").join(done, "id", "left_semi")


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= date '1998-01-01')")
def customers_without_orders(spark, root):
    # of the last months only: hardly any customer has no order at all
    recent = table(spark, root, "orders").where("o_orderdate >= date '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, root, "customer").select("c_custkey", "c_mktsegment").join(recent, "c_custkey", "left_anti")


@query("""with l as (select * from (select *, row_number() over (partition by document_level, source_id order by id desc) as rk from atlas_semantic_documents) where rk = 1 and length(content) >= 120 and document_level = 'message')
 select l.id, l.content_hash from l left join atlas_embedding_cache c on c.semantic_document_id = l.id and c.content_hash = l.content_hash and c.model_name = 'atlas-base-80' where c.id is null""")
def documents_not_embedded(spark, root):
    # the newest version of each message, long enough, that the model has not seen with this content
    d = table(spark, root, "atlas_semantic_documents").select("document_level", "source_id", "id", "content_hash", F.length("content").alias("n"))
    d = R.latest(d, ["document_level", "source_id"], ["id"]).where("n >= 120 and document_level = 'message'").select("id", "content_hash")
    cache = table(spark, root, "atlas_embedding_cache").where("model_name = 'atlas-base-80'").select(F.col("semantic_document_id").alias("id"), "content_hash")
    return d.join(cache, ["id", "content_hash"], "left_anti")


@query("select project_id, count(*) as n, count(distinct source_file_id) as sources from emails where project_id = 1 group by 1")
def project_scope(spark, root):
    return table(spark, root, "emails").where("project_id = 1").groupBy("project_id").agg(F.count("*").alias("n"), F.countDistinct("source_file_id").alias("sources"))


@query("""select user_id, min(ts) as first_ts, max(ts) as last_ts from events group by 1
          having cast(max(ts) as date) >= date '2024-01-10' and cast(min(ts) as date) <= date '2024-01-20'""")
def overlap_period_users(spark, root):
    spans = table(spark, root, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return spans.where((F.to_date("last_ts") >= "2024-01-10") & (F.to_date("first_ts") <= "2024-01-20"))


@query("select e.id, e.source_file_id from emails e where e.source_file_id in (select id from source_files where '/' || lower(replace(path, chr(92), '/')) like '%/inbox\\_%' escape '\\')")
def folder_filter(spark, root):
    path = F.concat(F.lit("/"), F.lower(F.replace("path", F.lit("\\"), F.lit("/"))))
    folders = table(spark, root, "source_files").where(path.contains("/inbox_")).select(F.col("id").alias("source_file_id"))
    return table(spark, root, "emails").select("id", "source_file_id").join(folders, "source_file_id", "left_semi")


@query("select id, subject, imported_at from emails where contains(lower(subject), 'sopralluogo') or contains(lower(sender), 'peszosco') order by imported_at desc, id limit 100")
def substring_search(spark, root):
    found = F.lower("subject").contains("sopralluogo") | F.lower("sender").contains("peszosco")
    return table(spark, root, "emails").where(found).select("id", "subject", "imported_at").orderBy(F.col("imported_at").desc(), "id").limit(100)


@query("""select id, (coalesce(has_attachments,0) = 1 or contains(lower(coalesce(subject,'')), 'pratica')) and not contains(lower(coalesce(sender,'')), 'notifiche') as flagged from emails""")
def boolean_flags(spark, root):
    has = lambda c, s: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(s)
    flag = ((F.coalesce("has_attachments", F.lit(0)) == 1) | has("subject", "pratica")) & ~has("sender", "notifiche")
    return table(spark, root, "emails").select("id", flag.alias("flagged"))


@query("select a.doc_id, n as same_lang_type from documents a join (select lang, doc_type, count(*) as n from documents group by 1, 2) b on a.lang is not distinct from b.lang and a.doc_type is not distinct from b.doc_type")
def null_safe_match(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang", "doc_type")
    keys = docs.groupBy(F.col("lang").alias("l"), F.col("doc_type").alias("t")).agg(F.count("*").alias("same_lang_type"))
    return docs.join(keys, F.col("lang").eqNullSafe(F.col("l")) & F.col("doc_type").eqNullSafe(F.col("t"))).select("doc_id", "same_lang_type")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(nullif(event_type, 'view'), 'other') as kind from events")
def json_props(spark, root):
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("other")).alias("kind"))


@query("""with o as (select o_custkey, count(*) as orders, count(*) filter (o_orderstatus = 'F') as done from orders group by 1),
          l as (select o.o_custkey, count(*) as items, count(distinct l_partkey) as parts from lineitem l join orders o on o.o_orderkey = l.l_orderkey group by 1)
          select c.c_custkey, coalesce(o.orders, 0) as orders, coalesce(o.done, 0) as done, coalesce(l.items, 0) as items, coalesce(l.parts, 0) as parts from customer c left join o on o.o_custkey = c.c_custkey left join l on l.o_custkey = c.c_custkey""")
def preaggregated_join(spark, root):
    orders = table(spark, root, "orders")
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    items = table(spark, root, "lineitem").select("l_orderkey", "l_partkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    items = items.groupBy("o_custkey").agg(F.count("*").alias("items"), F.countDistinct("l_partkey").alias("parts"))
    c = table(spark, root, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey")).join(o, "o_custkey", "left").join(items, "o_custkey", "left")
    return c.select("c_custkey", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("orders", "done", "items", "parts")])


@query("""select l_orderkey, l_linenumber, other from (select a.l_orderkey, a.l_linenumber, b.l_linenumber as other from
          (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as n from lineitem where l_returnflag = 'A') a join
          (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as n from lineitem where l_returnflag = 'R') b
          on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.n = b.n)""")
def keyed_rematch(spark, root):
    items = table(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    right = items.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("ro"), F.col("l_linenumber").alias("other"))
    both = R.rematch(items.where("l_returnflag = 'A'"), right, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], [F.col("ro"), F.col("other")])
    return both.select("l_orderkey", "l_linenumber", "other")


@query("""select r_name, n_name, string_agg(cast(c_custkey as varchar), ',' order by c_acctbal desc, c_custkey) as best from
          (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rk from customer) c
          join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where rk <= 8 group by 1, 2""")
def tree_assembly(spark, root):
    best = R.top_k(table(spark, root, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 8)
    leaves = best.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ",").alias("best"))
    nations = table(spark, root, "nation").join(table(spark, root, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return nations.join(leaves, "n_nationkey").select("r_name", "n_name", "best")


@query("""select project_id, count(*) as n, count(*) filter (has_attachments = 1) as with_attachments, count(*) filter (subject is null) as no_subject,
          count(distinct message_hash) as messages, count(*) filter (parse_status <> 'ok') as failed from emails group by 1""")
def conditional_counts(spark, root):
    return table(spark, root, "emails").groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("has_attachments") == 1).alias("with_attachments"), F.count_if(F.col("subject").isNull()).alias("no_subject"),
        F.countDistinct("message_hash").alias("messages"), F.count_if(F.col("parse_status") != "ok").alias("failed"))


@query("""select event_type, user_id, count(*) as n, count(*) filter (value > 50) as high, min(ts) as first_ts, max(ts) as last_ts from events group by 1, 2
          having count(*) filter (value > 50) > 2""")
def rollup_having(spark, root):
    g = table(spark, root, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.where("high > 2")


@query("""select p_brand, count(distinct p_partkey) as parts, coalesce(sum(items), 0)::bigint as items from part left join
          (select l_partkey, count(*) as items from lineitem group by 1) on l_partkey = p_partkey group by 1""")
def taxonomy_rollup(spark, root):
    items = table(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("items"))
    return table(spark, root, "part").select("p_partkey", "p_brand").join(items, "p_partkey", "left").groupBy("p_brand").agg(F.countDistinct("p_partkey").alias("parts"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))


@query("select s_nationkey, string_agg(distinct p_brand, ',' order by p_brand) as brands from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1")
def distinct_concat(spark, root):
    items = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    joined = items.join(table(spark, root, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(table(spark, root, "part").select("p_partkey", "p_brand"), "p_partkey")
    return joined.groupBy("s_nationkey").agg(R.concat_distinct("p_brand").alias("brands"))


@query("""select user_id, event_type, n, rk from (select *, row_number() over (partition by user_id order by n desc, first_id) as rk from
          (select user_id, event_type, count(*) as n, min(event_id) as first_id from events group by 1, 2)) where rk <= 3""")
def topk_first_seen(spark, root):
    counts = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return R.top_k(counts, ["user_id"], [F.col("n").desc(), F.col("first_id")], 3, "rk").select("user_id", "event_type", "n", "rk")


@query("select p_brand, p_partkey, p_retailprice, rk from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rk from part) where rk <= 5")
def topk_per_group(spark, root):
    return R.top_k(table(spark, root, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 5, "rk")


@query("select message_type, language, count(*) as n, round(100.0 * count(*) / (select count(*) from clean_texts), 6) as share from clean_texts group by 1, 2")
def type_histogram(spark, root):
    clean = table(spark, root, "clean_texts")
    total = clean.agg(F.count("*").alias("total"))
    g = clean.groupBy("message_type", "language").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(total)).select("message_type", "language", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))  # one row


@query("""select * from (select id, length(body_plain) as chars, 'short' as side from emails where body_plain is not null order by 2, 1 limit 20)
          union all select * from (select id, length(body_plain), 'long' from emails where body_plain is not null order by 2 desc, 1 limit 20)""")
def shortest_longest(spark, root):
    sized = table(spark, root, "emails").where("body_plain is not null").select("id", F.length("body_plain").cast("long").alias("chars"))
    return sized.orderBy("chars", "id").limit(20).withColumn("side", F.lit("short")).unionByName(sized.orderBy(F.col("chars").desc(), "id").limit(20).withColumn("side", F.lit("long")))


@query("select coalesce(sum(n - 1), 0)::bigint as probable_duplicates, count(*) as messages, max(n) as most from (select message_hash, count(*) as n from emails group by 1)")
def probable_duplicates(spark, root):
    g = table(spark, root, "emails").groupBy("message_hash").agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("probable_duplicates"), F.count("*").alias("messages"), F.max("n").alias("most"))


@query("select id, message_hash from emails qualify row_number() over (partition by message_hash order by id) = 1")
def first_writer_wins(spark, root):
    return table(spark, root, "emails").groupBy("message_hash").agg(F.min("id").alias("id"))


@query("""select lower(regexp_extract(sender, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1)) as address, count(*) as n from emails join source_files s on s.id = source_file_id
          where contains(lower(s.path), '/sent') and regexp_matches(sender, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') group by 1 order by 2 desc, 1 limit 10""")
def infer_accounts(spark, root):
    sent = table(spark, root, "source_files").where(F.lower("path").contains("/sent")).select(F.col("id").alias("source_file_id"))
    address = F.lower(F.regexp_extract("sender", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1))
    return table(spark, root, "emails").select("source_file_id", address.alias("address")).where("address <> ''").join(sent, "source_file_id", "left_semi").groupBy("address").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "address").limit(10)


@query("""select label, count(*) as n, rank() over (order by count(*) desc, label) as place from embeddings group by 1""")
def multi_key_order(spark, root):
    # as many rows as labels, so one task may rank them
    return table(spark, root, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("place", F.rank().over(Window.orderBy(F.col("n").desc(), "label")))


@query("""select count(*) as clusters, min(n) as smallest, quantile_cont(n, 0.5) as middle, avg(n) as mean, max(n) as largest, count(*) filter (n < 40) as small, count(*) filter (n > 0.12 * total) as large
          from (select label, count(*) as n, (select count(*) from embeddings) as total from embeddings group by 1)""")
def cluster_sizes(spark, root):
    e = table(spark, root, "embeddings")
    g = e.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(e.agg(F.count("*").alias("total"))))  # one row
    return g.agg(F.count("*").alias("clusters"), F.min("n").alias("smallest"), F.percentile("n", 0.5).alias("middle"), F.avg("n").alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") < 40).alias("small"), F.count_if(F.col("n") > 0.12 * F.col("total")).alias("large"))


@query("""select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by src desc, ts desc, event_id desc) as rk from
          (select 0 as src, * from events where ts < timestamp '2024-01-15' union all select 1, * from events where ts >= timestamp '2024-01-15')) where rk = 1""")
def upsert_latest(spark, root):
    e = table(spark, root, "events").select("user_id", "event_type", "value", "ts", "event_id")
    part = lambda w: R.latest(e.where(w), ["user_id", "event_type"], ["ts", "event_id"])
    return R.upsert(part("ts < timestamp_ntz '2024-01-15 00:00:00'"), part("ts >= timestamp_ntz '2024-01-15 00:00:00'"), ["user_id", "event_type"]).select("user_id", "event_type", "value")


@query("""select coalesce(o.user_id, n.user_id) as user_id, case when n.user_id is null or o.kind = 'purchase' then o.kind else n.kind end as kind from
          (select user_id, arg_max(event_type, (ts, event_id)) as kind from events where ts < timestamp '2024-01-15' group by 1) o full join
          (select user_id, arg_max(event_type, (ts, event_id)) as kind from events where ts >= timestamp '2024-01-15' group by 1) n on o.user_id = n.user_id""")
def upsert_protected(spark, root):
    e = table(spark, root, "events")
    part = lambda w: e.where(w).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return R.upsert(part("ts < timestamp_ntz '2024-01-15 00:00:00'"), part("ts >= timestamp_ntz '2024-01-15 00:00:00'"), ["user_id"], F.col("o.kind") == "purchase")


@query("""select o_custkey, o_orderkey from orders where o_orderstatus = 'F' union all
          (select o_custkey, min(o_orderkey) from orders where o_orderstatus = 'O' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F') group by 1)""")
def insert_or_ignore(spark, root):
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.insert_ignore(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["o_custkey"], [F.col("o_orderkey")])


@query("""select 'clean_texts' as child, count(*) as violations from clean_texts where email_id not in (select id from emails) union all
          select 'emails', count(*) from emails where source_file_id is not null and source_file_id not in (select id from source_files) union all
          select 'atlas_embedding_cache', count(*) from atlas_embedding_cache where semantic_document_id not in (select id from atlas_semantic_documents) union all
          select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)""")
def integrity_violations(spark, root):
    t = lambda n: table(spark, root, n)
    checks = (("clean_texts", "email_id", "emails", "id"), ("emails", "source_file_id", "source_files", "id"), ("atlas_embedding_cache", "semantic_document_id", "atlas_semantic_documents", "id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))
    parts = [R.orphans(t(c), k, t(p), pk).agg(F.count("*").alias("violations")).select(F.lit(c).alias("child"), "violations") for c, k, p, pk in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""select user_id, event_type, count(*) as changes, arg_max(value, (ts, event_id)) as value from events group by 1, 2""")
def event_fold_state(spark, root):
    return R.fold_events(table(spark, root, "events"), "user_id", "event_type", "value", ["ts", "event_id"])


@query("select distinct lang as value, 'lang' as kind from documents where lang is not null union select distinct doc_type, 'doc_type' from documents where doc_type is not null")
def union_signals(spark, root):
    d = table(spark, root, "documents")
    part = lambda c: d.where(F.col(c).isNotNull()).select(F.col(c).alias("value"), F.lit(c).alias("kind"))
    return part("lang").unionByName(part("doc_type")).distinct()


@query("select distinct c_nationkey as nation from customer except select distinct s_nationkey from supplier where s_acctbal < 0")
def set_difference(spark, root):
    poor = table(spark, root, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return table(spark, root, "customer").select(F.col("c_nationkey").alias("nation")).distinct().join(poor, "nation", "left_anti")


@query("""select d.doc_id, coalesce(nullif(c.message_type, ''), nullif(d.doc_type, ''), 'unknown') as label from documents d left join
          (select email_id, arg_max(message_type, id) as message_type from clean_texts group by 1) c on c.email_id = d.email_id""")
def label_precedence(spark, root):
    c = table(spark, root, "clean_texts").groupBy("email_id").agg(F.max_by("message_type", "id").alias("message_type"))
    return table(spark, root, "documents").select("doc_id", "email_id", "doc_type").join(c, "email_id", "left").select("doc_id", F.coalesce(F.nullif("message_type", F.lit("")), F.nullif("doc_type", F.lit("")), F.lit("unknown")).alias("label"))


@query("""select id, rule from (select e.id, r.rule, row_number() over (partition by e.id order by r.priority desc, r.rule) as rk from emails e join
          (values (1, 30, 'subject', 'sopralluogo'), (2, 20, 'subject', 'pratica'), (3, 20, 'sender', 'peszosco'), (4, 10, 'subject', 're:')) r(rule, priority, field, marker)
          on contains(lower(coalesce(case when r.field = 'subject' then e.subject else e.sender end, '')), r.marker)) where rk = 1""")
def rule_first_match(spark, root):
    rules = spark.createDataFrame([(1, 30, "subject", "sopralluogo"), (2, 20, "subject", "pratica"), (3, 20, "sender", "peszosco"), (4, 10, "subject", "re:")], "rule int, priority int, field string, marker string")
    value = F.lower(F.coalesce(F.when(F.col("field") == "subject", F.col("subject")).otherwise(F.col("sender")), F.lit("")))
    hits = table(spark, root, "emails").select("id", "subject", "sender").join(F.broadcast(rules), value.contains(F.col("marker")))  # hand-written rules
    return hits.groupBy("id").agg(F.max_by("rule", F.struct("priority", -F.col("rule"))).alias("rule"))
