"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carteggio.llm import clusters, mojibake, names, packing, pii, quotes, splitting, threads, tokens
from carteggio.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return names.link(table(spark, root, "atlas_entities"), table(spark, root, "emails"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    found = threads.conversations(table(spark, root, "emails"), table(spark, root, "source_files"), table(spark, root, "own_accounts"))
    return found.where("kept").select("conversation_id", "id", "turn", "speaker")


def p3_paths(spark: SparkSession, root: str) -> DataFrame:
    return threads.paths(threads.conversations(table(spark, root, "emails"), table(spark, root, "source_files"), table(spark, root, "own_accounts")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.pieces(table(spark, root, "atlas_semantic_documents")).where("piece = 0").select("id", "cut")


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.pieces(table(spark, root, "atlas_semantic_documents"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return pii.find(table(spark, root, "emails")).select("id", "field", "kind", "start_pos")


def p5_redacted(spark: SparkSession, root: str) -> DataFrame:
    return pii.redact(table(spark, root, "emails"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return clusters.cluster(table(spark, root, "atlas_embedding_cache"))[0]


def p6_clusters(spark: SparkSession, root: str) -> DataFrame:
    return clusters.cluster(table(spark, root, "atlas_embedding_cache"))[1]


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return quotes.lines(table(spark, root, "emails")).select("id", "line_no", "kind")


def p7_texts(spark: SparkSession, root: str) -> DataFrame:
    emails = table(spark, root, "emails")
    return quotes.split(emails, quotes.lines(emails))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", tokens.encode(F.col("text")).alias("ids"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    sizes = table(spark, root, "documents").where("text is not null and text <> ''").select("doc_id", tokens.count(F.col("text")).alias("n_tokens"))
    return packing.pack(sizes, 2048)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    found = mojibake.repair(table(spark, root, "documents"))
    return found.select("doc_id", F.when(F.col("status") == "lost", "lost").otherwise(F.md5("restored")).alias("restored_md5"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_paths, p4_found, p4_pieces, p5_found, p5_redacted, p6_found, p6_clusters, p7_found, p7_texts, p8_ids, p9_containers, p10_found)}
SQL: dict[str, str] = {
    "p4_found": r"""select id, case when list_max(list_transform(regexp_split_to_array(content, '[\x09-\x0d\x1c-\x1f\x{85}\pZ.!?;。]'), lambda x: length(x))) > 2000 then 'forced' else 'split' end as cut
        from atlas_semantic_documents where length(content) > 2000""",
    "p6_found": """with recursive l as (select model_name, len(embedding) as d, count(*) as n from atlas_embedding_cache where embedding is not null and model_name is not null group by 1, 2),
        u as (select model_name, arg_max(d, (n, d)) as d from l group by 1),
        v as (select c.id, c.model_name, c.embedding::double[] as e from atlas_embedding_cache c join u on u.model_name = c.model_name and len(c.embedding) = u.d
              where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e as (select a.id as a, b.id as b from v a join v b on a.model_name = b.model_name and a.id <> b.id and list_cosine_similarity(a.e, b.e) >= 0.8),
        r(id, root) as (select id, id from v union select e.b, r.root from r join e on e.a = r.id), c as (select id, min(root) as cluster_id from r group by 1)
        select id, cluster_id from c where cluster_id in (select cluster_id from c group by 1 having count(*) >= 5)""",
}
