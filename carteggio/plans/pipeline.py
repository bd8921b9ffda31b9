"""The study of an archive as named stages; each is written once and reused while its inputs and options stay the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carteggio.functions import cleaning
from carteggio.functions import text as T
from carteggio.operators import conversations as C
from carteggio.operators import discovery, terms
from carteggio.operators.timestamps import normalise
from carteggio.session import cut, tidy
from carteggio.sources import mailbox, sinks
from carteggio.sources.tables import table

Stage = Callable[[SparkSession, str, dict[str, DataFrame], dict], DataFrame]


def cleaned(spark, root, done, options):
    e = table(spark, root, "emails").where("body_plain is not null")
    body = T.whitespace(F.col("body_plain"))
    return e.select("id", T.subject(F.col("subject")).alias("subject_clean"), body.alias("body"), T.language(body).alias("language"), T.quality(body).alias("quality"))


def dated(spark, root, done, options):
    return normalise(table(spark, root, "emails").select("id", "source_file_id", "sent_at", "imported_at"), table(spark, root, "source_files")).select("id", "sent_us")


def linked(spark, root, done, options):
    e = table(spark, root, "emails")
    m = e.select("id", "subject", "sender", "recipients").join(done["dated"], "id").withColumn("at", F.timestamp_micros("sent_us")).join(C.participants(e), "id")
    return C.islands(C.subject_links(m, options.get("days", 45)))


def folded(spark, root, done, options):
    e = table(spark, root, "emails").select("id", "subject", "sender", "has_attachments", "recipients")
    m = e.join(done["linked"], "id").join(done["dated"], "id").withColumn("at", F.timestamp_micros("sent_us")).join(C.participants(e), "id")
    own = table(spark, root, "own_accounts").agg(F.collect_set(F.lower("address")).alias("own"))  # the archive's own mailboxes: one row
    low = F.lower(F.coalesce("sender", F.lit("")))
    return C.fold(m.crossJoin(F.broadcast(own)).withColumn("outgoing", F.exists("own", lambda a: low.contains(a))))


def texts(spark, root, done, options):
    return C.unique_text(done["linked"].join(done["cleaned"].select("id", "body"), "id"), "conversation_id", "id", "body")


def vocabulary(spark, root, done, options):
    return terms.vocabulary(terms.term_counts(done["texts"], "conversation_id", T.words(F.col("text"), 3)), "conversation_id", options.get("terms", 500))


#: Name, stages it reads, function.
STAGES: tuple[tuple[str, tuple[str, ...], Stage], ...] = (
    ("cleaned", (), cleaned), ("dated", (), dated), ("linked", ("dated",), linked), ("folded", ("linked", "dated"), folded),
    ("texts", ("linked", "cleaned"), texts), ("vocabulary", ("texts",), vocabulary),
)


def manifest(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of every file below ``root``, by the file system: no content is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def run(spark: SparkSession, root: str, workspace: str, options: dict | None = None, targets: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The stages (all, or ``targets`` with what they read) as tables below ``workspace``.

    A stage's folder carries a fingerprint of its options, of the input files and of the stages it reads, so a changed
    option or new mail rebuilds that stage and what follows, and a finished one is read back. A stage that was cut off has no success mark and is rebuilt.
    """
    options = options or {}
    wanted = set(targets or [n for n, _, _ in STAGES])
    for name, reads, _ in reversed(STAGES):
        if name in wanted:
            wanted |= set(reads)
    inputs = manifest(spark, root)
    done: dict[str, DataFrame] = {}
    marks: dict[str, str] = {}
    for name, reads, build in STAGES:
        if name not in wanted:
            continue
        marks[name] = hashlib.sha256(json.dumps([name, inputs, options.get(name, {}), [marks[r] for r in reads]], sort_keys=True).encode()).hexdigest()[:16]
        path = f"{workspace.rstrip('/')}/{name}-{marks[name]}"
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            build(spark, root, {r: done[r] for r in reads}, options.get(name, {})).write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
    return done


@tidy
def study_mailboxes(spark: SparkSession, folder: str, out: str, accounts: tuple[str, ...] = ()) -> dict[str, int]:
    """A folder of mailboxes to a study pack below ``out``: read, deduplicate, clean, rebuild conversations, count, export.

    Returns the rows of each artifact: messages, errors, clean_texts, conversations, conversation_messages, terms, nodes, edges.
    """
    found, _ = cut(mailbox.messages(mailbox.scan(spark, folder)))
    fresh = mailbox.unseen(found, found.where("false").select("message_hash"))
    # ids that do not depend on the number of tasks or their order
    messages = fresh.withColumn("id", F.xxhash64("message_hash")).withColumn("at", F.to_timestamp("sent_at_iso"))
    messages, _ = cut(messages)
    rows = messages.select("id", "subject", F.col("body_text").alias("body_plain"), (F.size("attachments") > 0).cast("int").alias("has_attachments"))
    clean, _ = cut(cleaning.clean_text(rows).drop("subject", "body_plain"))
    people = F.array_distinct(F.filter(F.transform(F.concat(F.array("sender"), "recipients"), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    m = messages.join(clean.select("id", "subject_clean"), "id").select(
        "id", "at", C.message_id(F.col("message_id")).alias("own"), C.cited_ids(F.col("headers_json")).alias("cited"), F.lower("subject_clean").alias("subject_key"), people.alias("participants"), "message_hash",
    )
    members = C.reconstruct(m)
    low = F.lower(F.coalesce("sender", F.lit("")))
    own = F.exists(F.array(*[F.lit(a.lower()) for a in accounts]), lambda a: low.contains(a)) if accounts else F.lit(False)
    facts = messages.select("id", "at", "subject", (F.size("attachments") > 0).cast("int").alias("has_attachments"), own.alias("outgoing")).join(m.select("id", "participants"), "id").join(members, "id")
    conversations = C.fold(facts).join(C.graded(members), "conversation_id").join(C.stable_key_or_fallback(m.join(members, "id")), "conversation_id")
    order = Window.partitionBy("conversation_id").orderBy(F.col("at").asc_nulls_last(), "id")
    placed = facts.select("conversation_id", "id", "relation", (F.row_number().over(order) - 1).alias("position"))
    counts = terms.term_counts(clean.where("not excluded"), "id", T.words(F.col("semantic_text"), 3))
    edges, _ = cut(discovery.graph(messages, "id", {"domain": T.domains(F.coalesce("sender", F.lit(""))), "person": F.col("recipients")}))
    return sinks.study_pack(
        {"messages": messages, "errors": mailbox.errors(found), "clean_texts": clean, "conversations": conversations, "conversation_messages": placed,
         "terms": terms.vocabulary(counts, "id", 500), "nodes": discovery.nodes(edges), "edges": edges}, out,
    )
