"""Conversations by subject, participants and time, and folds over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carteggio.functions import text
from carteggio.operators.graph import connected_components
from carteggio.session import cut, tidy

US_DAY = 86_400_000_000
# Subjects too general to link by.
GENERAL = ("documenti", "informazioni", "richiesta", "aggiornamento", "comunicazione")
#: The same in English, for archives that need them.
GENERAL_ENGLISH = ("documents", "request", "update")


def participants(emails: DataFrame) -> DataFrame:
    """(id, participants): addresses of sender and recipients, lower case, without repeats, in order."""
    both = F.lower(F.concat_ws(" ", "sender", "recipients"))
    found = F.regexp_extract_all(both, F.lit(r"([a-z0-9._%+-]+@[a-z0-9.-]+[a-z0-9])"), 1)
    return emails.select("id", F.array_sort(F.array_distinct(found)).alias("participants"))


def message_id(c: Column) -> Column:
    """A Message-ID without blanks and brackets at its ends, lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(c), "^[<>]+|[<>]+$", "")), F.lit(""))


def cited_ids(headers: Column) -> Column:
    """Message-IDs of References, then of In-Reply-To, from header JSON; none where it is null or cut off."""
    h = F.from_json(headers, "map<string,string>")
    of = lambda name: F.coalesce(F.regexp_extract_all(h[name], F.lit("<([^>]+)>"), 1), F.array().cast("array<string>"))
    return F.filter(F.transform(F.concat(of("References"), of("In-Reply-To")), message_id), lambda x: x.isNotNull())


def people(emails: DataFrame) -> Column:
    """The From header as written and all addresses of To, lower case and trimmed, each once."""
    to = F.coalesce(F.from_json("recipients", "array<string>"), F.array().cast("array<string>"))
    all_ = F.transform(F.concat(F.array("sender"), to), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(all_, lambda x: x.isNotNull() & (x != "")))


def header_links(messages: DataFrame) -> DataFrame:
    """(id, target): every cited message that is there; of several with one Message-ID the last by (at, id).

    ``messages`` has id, at, own, cited.
    """
    owners = messages.where("own is not null").groupBy("own").agg(F.max_by("id", F.struct("at", "id")).alias("target"))
    return messages.select("id", F.explode("cited").alias("own")).distinct().join(owners, "own").select("id", "target").distinct()


def subject_links(messages: DataFrame, days: int = 45, least: int = 8, general: tuple[str, ...] = GENERAL, headed: DataFrame | None = None) -> DataFrame:
    """(id, subject_key, at, previous, linked): each message against the one before it with the same subject.

    ``messages`` has id, subject (or subject_key), at (timestamp), participants. Linked if at most ``days`` whole days
    apart with a participant in common; short and general subjects are left out. ``headed`` (id) are messages linked by
    their headers: others may follow them, they follow none. Neighbours are found day by day, so that no task sorts a
    whole subject.
    """
    key = F.col("subject_key") if "subject_key" in messages.columns else text.subject(F.col("subject"))
    m = messages.withColumn("subject_key", key).where((F.length("subject_key") >= least) & ~F.col("subject_key").isin(*general))
    m = m.select("id", "subject_key", "at", "participants", F.coalesce(F.to_date("at"), F.lit("9999-12-31").cast("date")).alias("day"))
    me = F.struct("at", "id", "participants")
    by_day = Window.partitionBy("subject_key").orderBy("day")
    ends = m.groupBy("subject_key", "day").agg(F.max_by(me, F.struct(F.col("at").isNull(), "at", "id")).alias("last"))
    before = ends.select("subject_key", "day", F.lag("last").over(by_day).alias("before"))
    m = m.withColumn("p", F.lag(me).over(Window.partitionBy("subject_key", "day").orderBy(F.col("at").asc_nulls_last(), "id")))
    m = m.join(before, ["subject_key", "day"]).withColumn("p", F.coalesce("p", "before"))
    near = F.abs(F.floor((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("p.at").cast("timestamp"))) / US_DAY)) <= days
    linked = F.coalesce(near & F.arrays_overlap("participants", "p.participants"), F.lit(False))
    if headed is not None:
        m = m.join(headed.select("id").distinct().withColumn("_h", F.lit(True)), "id", "left")
        linked = linked & F.col("_h").isNull()
    return m.select("id", "subject_key", "at", F.col("p.id").alias("previous"), linked.alias("linked"))


def islands(links: DataFrame) -> DataFrame:
    """(id, conversation_id): chains of :func:`subject_links`, named by their smallest id.

    Breaks are counted within days and carried over days, so no task holds a whole subject.
    """
    m = links.withColumn("day", F.coalesce(F.to_date("at"), F.lit("9999-12-31").cast("date"))).withColumn("cut", (~F.col("linked")).cast("int"))
    by_day = Window.partitionBy("subject_key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = m.groupBy("subject_key", "day").agg(F.sum("cut").alias("cuts"))
    carried = days.select("subject_key", "day", (F.sum("cuts").over(by_day) - F.col("cuts")).alias("carried"))
    inside = F.sum("cut").over(Window.partitionBy("subject_key", "day").orderBy(F.col("at").asc_nulls_last(), "id"))
    chains = m.withColumn("inside", inside).join(carried, ["subject_key", "day"]).select("id", "subject_key", (F.col("inside") + F.col("carried")).alias("chain"))
    names = chains.groupBy("subject_key", "chain").agg(F.min("id").alias("conversation_id"))
    return chains.join(names, ["subject_key", "chain"]).select("id", "conversation_id")


# How sure a conversation is by the way it was found, and why.
METHODS = (("headers", 0.95, None), ("subject_participants_date", 0.65, "Fallback: stesso oggetto normalizzato, partecipanti comuni e massimo 45 giorni."), ("isolated", 0.4, "Nessuna relazione sufficientemente affidabile trovata."))


@tidy
def reconstruct(messages: DataFrame, days: int = 45, general: tuple[str, ...] = GENERAL) -> DataFrame:
    """(id, conversation_id, relation): messages joined by their headers, else by subject, people and time.

    ``messages`` has id, at, own, cited, subject_key, participants. ``relation`` is ``headers``,
    ``subject_participants_date`` or ``isolated`` for the message itself; conversations are named by their smallest id.
    """
    rows, _ = cut(messages.select("id", "at", "own", "cited", "subject_key", "participants"))
    by_header, _ = cut(header_links(rows))
    linked, _ = cut(subject_links(rows, days, general=general, headed=by_header).where("linked").select("id", F.col("previous").alias("target")))
    whole = connected_components(by_header.unionByName(linked), "id", "target")
    relation = by_header.select("id", F.lit(1).alias("r")).distinct().unionByName(linked.select("id", F.lit(2).alias("r"))).groupBy("id").agg(F.min("r").alias("r"))
    out = rows.select("id").join(whole.select(F.col("node").alias("id"), "component"), "id", "left").join(relation, "id", "left")
    names = F.when(F.col("r") == 1, METHODS[0][0]).when(F.col("r") == 2, METHODS[1][0]).otherwise(METHODS[2][0])
    out, _ = cut(out.select("id", F.coalesce("component", "id").alias("conversation_id"), names.alias("relation")))
    return out


def graded(members: DataFrame) -> DataFrame:
    """(conversation_id, method, confidence, warning): the surest way any of its messages was linked."""
    rank = F.when(F.col("relation") == METHODS[0][0], 0).when(F.col("relation") == METHODS[1][0], 1).otherwise(2)
    of = members.groupBy("conversation_id").agg(F.min(rank).alias("r"))
    pick = lambda i: F.when(F.col("r") == 0, F.lit(METHODS[0][i])).when(F.col("r") == 1, F.lit(METHODS[1][i])).otherwise(F.lit(METHODS[2][i]))
    return of.select("conversation_id", pick(0).alias("method"), pick(1).alias("confidence"), pick(2).alias("warning"))


def report(members: DataFrame, conversations: DataFrame, general_messages: DataFrame) -> DataFrame:
    """One row of counters over a reconstruction; ``conversations`` has conversation_id, message_count, method, confidence."""
    n = conversations.agg(
        F.count("*").alias("conversations"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("emails"), F.count_if(F.col("message_count") == 1).alias("isolated"),
        F.count_if(F.col("message_count") > 1).alias("multi_message"), F.count_if(F.col("method") == "headers").alias("header_based"),
        F.count_if(F.col("method") == "subject_participants_date").alias("fallback_based"), F.count_if(F.col("confidence") < 0.6).alias("low_confidence"),
    )
    links = members.agg(F.count_if(F.col("relation") == "headers").alias("explicit_links"), F.count_if(F.col("relation") == "subject_participants_date").alias("fallback_links"))
    general = general_messages.agg(F.count("*").alias("general_subjects"))
    one = n.crossJoin(F.broadcast(links)).crossJoin(F.broadcast(general))  # one row each
    share = lambda a, b, places: F.round(a / F.greatest(b, F.lit(1)), places)
    return one.select(
        "*", share(F.col("isolated") * 100, F.col("conversations"), 1).alias("isolated_percent"), share(F.col("emails"), F.col("conversations"), 2).alias("mean_messages"),
        F.round(1 - F.col("conversations") / F.greatest(F.col("emails"), F.lit(1)), 3).alias("reduction_ratio"),
    )


def judgement(r: DataFrame) -> DataFrame:
    """``report`` plus ``judgement``."""
    fragile = (F.col("isolated_percent") >= 75) | (F.col("fallback_based") > F.col("header_based")) & (F.col("low_confidence") >= F.col("conversations") / 2)
    good = (F.col("header_based") >= 3) & (F.col("multi_message") >= 3)
    empty = (F.col("conversations") == 0) | (F.col("emails") == 0)
    return r.withColumn("judgement", F.when(empty, "Non verificabile").when(fragile, "Fragile").when(good, "Buono").otherwise("Accettabile"))


def groups(conversations: DataFrame, longest: int = 20) -> DataFrame:
    """(group, conversation_id) for review: to_check, headers, fallback, isolated, warnings, and the ``longest`` ones."""
    flags = F.array(
        F.when((F.col("confidence") < 0.7) | F.col("warning").isNotNull(), "to_check"), F.when(F.col("method") == "headers", "headers"),
        F.when(F.col("method") == "subject_participants_date", "fallback"), F.when(F.col("message_count") == 1, "isolated"), F.when(F.col("warning").isNotNull(), "warnings"),
    )
    all_ = conversations.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("group"), "conversation_id")
    long = conversations.orderBy(F.col("message_count").desc(), "conversation_id").limit(longest).select(F.lit("long").alias("group"), "conversation_id")
    return all_.unionByName(long)


def may_rebuild(stored_messages: int, messages: int, stored_conversations: int, mode: str = "safe") -> bool:
    """Whether conversations are to be built anew: always if none are stored or in mode ``rebuild-derived``.

    In mode ``safe`` stored ones are kept if they hold all messages; if they do not, that is an error, so that reviews
    attached to them are not lost.
    """
    if mode not in ("safe", "rebuild-derived"):
        raise ValueError("mode is safe or rebuild-derived")
    if not stored_conversations or mode == "rebuild-derived":
        return True
    if stored_messages != messages:
        raise ValueError(f"{max(0, messages - stored_messages)} messages belong to no stored conversation; rebuild with mode rebuild-derived")
    return False


def fold(messages: DataFrame) -> DataFrame:
    """One row per conversation_id: counts, direction, span of time, last subject, participants."""
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.count_if("outgoing").alias("outgoing"), F.count_if(~F.col("outgoing")).alias("incoming"),
        F.sum(F.col("has_attachments").cast("long")).alias("with_attachments"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.max_by("subject", F.struct("at", "id")).alias("last_subject"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("participants")))), ",").alias("participants"),
    )


def unique_text(messages: DataFrame, conversation: str, order: str, body: str) -> DataFrame:
    """(conversation, parts, text): trimmed texts in order, each once (by hash), joined by an empty line."""
    m = messages.withColumn("_t", F.regexp_replace(body, r"^\s+|\s+$", "")).where("_t is not null and _t <> ''").withColumn("_h", F.sha2("_t", 256))
    once = m.groupBy(conversation, "_h").agg(F.min(F.struct(order, "_t")).alias("m"))
    return once.groupBy(conversation).agg(F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["_t"]), "\n\n").alias("text"))


def stable_key(members: DataFrame, conversation: str, *parts: str) -> DataFrame:
    """(conversation, key): hash over the sorted values of ``parts``, the same whatever the order of import."""
    lists = [F.array_join(F.array_sort(F.collect_set(p)), "|") for p in parts]
    return members.groupBy(conversation).agg(F.sha2(F.concat_ws("#", *lists), 256).alias("key"))


def stable_key_or_fallback(members: DataFrame) -> DataFrame:
    """(conversation_id, key) over Message-IDs and content hashes; without any id over last subject, first day and people.

    ``members`` has conversation_id, id, at, own, message_hash, subject_key, participants. The key does not depend on row ids.
    """
    of = members.groupBy("conversation_id").agg(
        F.array_join(F.array_sort(F.collect_list("own")), "|").alias("ids"), F.array_join(F.array_sort(F.collect_list(F.coalesce("message_hash", F.lit("")))), "|").alias("hashes"),
        F.max_by("subject_key", F.struct("at", "id")).alias("subject"), F.min("at").alias("first"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("participants")))), "|").alias("people"),
    )
    by_id = F.concat(F.lit("message-ids|"), "ids", F.lit("|message-hashes|"), "hashes")
    day = F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit(""))
    other = F.concat(F.lit("fallback|"), F.coalesce("subject", F.lit("")), F.lit("|"), day, F.lit("|"), "people", F.lit("|message-hashes|"), "hashes")
    return of.select("conversation_id", F.sha2(F.when(F.col("ids") != "", by_id).otherwise(other), 256).alias("key"))


def analysis_text(texts: DataFrame, subjects: DataFrame, longest: int = 50_000) -> DataFrame:
    """(conversation_id, analysis): last subject and the different texts of a conversation, at most ``longest`` characters.

    ``texts`` is (conversation_id, position, body). Copies go by their hash before any text moves; then only as many
    texts of a conversation are joined as the room can hold.
    """
    room = Window.partitionBy("conversation_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    t = texts.withColumn("_t", F.regexp_replace("body", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).where("_t is not null and _t <> ''")
    first = t.groupBy("conversation_id", F.sha2("_t", 256).alias("_h")).agg(F.min("position").alias("position"), F.min(F.least(F.length("_t"), F.lit(longest))).alias("n"))
    kept = first.withColumn("used", F.coalesce(F.sum(F.col("n") + 2).over(room), F.lit(0))).where(F.col("used") < longest).select("conversation_id", "position")
    part = t.join(kept, ["conversation_id", "position"], "left_semi").select("conversation_id", "position", F.substring("_t", 1, longest).alias("_t"))
    joined = part.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))
    both = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return subjects.join(joined, "conversation_id", "left").select("conversation_id", F.substring(both, 1, longest).alias("analysis"))
