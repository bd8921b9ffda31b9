"""Rebuild conversations from message rows (problem 3).

Parent pointers come from References and In-Reply-To; they are flattened to roots by pointer jumping, links whose
target is missing mark orphans, links that would point forward in time are taken out of the forest (a cycle needs
at least one of them); on the graph of trees that these links form, which is small, those that close a cycle are told
from those that only have a wrong clock. The remaining links between trees (further citations, shared thread keys) join
whole trees, again by pointer jumping on the contracted graph. Paths from roots to leaves come from tables of
ancestors at doubling distances. Only narrow rows are shuffled: no text leaves the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carteggio.operators.graph import connected_components, jump
from carteggio.operators.timestamps import normalise
from carteggio.session import cut, tidy

DAY_US = 86_400_000_000


def clean_id(c: Column) -> Column:
    """A message-id without case, brackets and blanks; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[<>\s\p{Z}]+", "")), F.lit(""))


def header(headers: Column, name: str) -> Column:
    """All values of a header, whatever the case of its name, joined by a blank; null if there is none."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(F.trim(e["key"])) == name)
    return F.when(F.size(found) > 0, F.concat_ws(" ", F.transform(found, lambda e: e["value"])))


def ids_in(c: Column) -> Column:
    """The message-ids of a header: what stands in angle brackets, else every word with an at sign."""
    bracketed = F.regexp_extract_all(c, F.lit("<([^<>]+)>"), 1)
    words = F.filter(F.split(c, r"[\s,;]+"), lambda w: w.contains("@"))
    found = F.when(F.size(bracketed) > 0, bracketed).otherwise(words)
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), clean_id), lambda x: x.isNotNull())


def address_in(c: Column) -> Column:
    """The last e-mail address of a text, lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"([^\s<>()\"',;:@]+@[^\s<>()\"',;:@]+)[^@]*$", 1)), F.lit(""))


def messages(emails: DataFrame, sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """One narrow row per message: (id, own, cited, key, sent_us, blank, outgoing).

    Rows with equal ``message_hash`` are one message under the smallest id; a null hash is a message of its own.
    Header JSON that is null, empty or cut off counts as no headers.
    """
    headers = F.from_json("raw_headers_json", "map<string,string>")
    rows = emails.select("id", "source_file_id", "sent_at", "imported_at", "message_hash", "original_message_id", "sender", "thread_key",
                         headers.alias("h"), (~F.coalesce(F.col("body_plain"), F.lit("")).rlike(r"[^\s\p{Z}]")).alias("blank"))
    rows = rows.select(
        "id", "source_file_id", "sent_at", "imported_at", "message_hash", "blank",
        F.coalesce(clean_id(F.col("original_message_id")), F.get(ids_in(header(F.col("h"), "message-id")), F.lit(0))).alias("own"),
        F.concat(ids_in(header(F.col("h"), "references")), ids_in(header(F.col("h"), "in-reply-to"))).alias("cited"),
        F.when(F.col("thread_key").startswith("t-"), F.col("thread_key")).alias("key"),
        F.coalesce(address_in(F.col("sender")), address_in(header(F.col("h"), "from"))).alias("address"),
    )
    ours = accounts.select(F.lower(F.trim("address")).alias("address"), F.lit(True).alias("outgoing")).distinct()
    rows = normalise(rows, sources).join(ours, "address", "left")
    one = rows.groupBy(F.coalesce(F.col("message_hash"), F.concat(F.lit("id "), F.col("id").cast("string"))).alias("h"))
    body = F.struct("id", "own", "cited", "key", "sent_us", "blank", F.coalesce("outgoing", F.lit(False)).alias("outgoing"))
    return one.agg(F.min_by(body, "id").alias("m")).select("m.*")


def cycles(backward: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the messages whose backward link (id, parent) closes a cycle; ``roots`` (id, root) is the forest without them.

    Every such message is a root, so the links are pointers between trees. A connected set of them with as many links as
    trees goes round; one with a link less is itself a tree.
    """
    to = backward.join(roots.select(F.col("id").alias("parent"), "root"), "parent", "left").select("id", F.coalesce("root", "parent").alias("to"))
    to, _ = cut(to)
    sets = connected_components(to, "id", "to")
    name = lambda df, c: df.join(sets.select(F.col("node").alias(c), "component"), c, "left").select(F.coalesce("component", c).alias("set"), c)
    links = name(to.select("id"), "id")
    trees = links.select("set", F.col("id").alias("tree")).unionByName(name(to.select("to"), "to").select("set", F.col("to").alias("tree"))).distinct()
    n = links.groupBy("set").agg(F.count("*").alias("links")).join(trees.groupBy("set").agg(F.count("*").alias("trees")), "set")
    return links.join(n.where("links = trees").select("set"), "set").select("id")


@tidy
def paths(found: DataFrame) -> DataFrame:
    """(conversation_id, leaf, step, id): for each message nobody answers the way from its root to it, steps from 1.

    ``found`` is a result of :func:`conversations`; only kept conversations have paths. Links that are backward are no
    part of a path. Each round doubles the reach: the ways found so far are continued from their ends by a table of
    ancestors at twice the distance.
    """
    rows, _ = cut(found.where("kept").select("conversation_id", "id", F.when(~F.col("backward"), F.col("parent")).alias("parent")))
    rows = rows.join(rows.select(F.col("id").alias("parent"), F.col("conversation_id").alias("c")), "parent", "left").select("conversation_id", "id", F.when(F.col("c") == F.col("conversation_id"), F.col("parent")).alias("parent"))
    jump_, _ = cut(rows.where("parent is not null").select(F.col("id").alias("at"), F.col("parent").alias("to")))
    answered = jump_.select(F.col("to").alias("id")).distinct()
    ways, _ = cut(rows.join(answered, "id", "left_anti").select("conversation_id", F.col("id").alias("leaf"), F.lit(0).cast("long").alias("up"), "id"))
    distance = 1
    while jump_.limit(1).count():
        onward = ways.join(jump_, ways.id == jump_["at"]).select("conversation_id", "leaf", (F.col("up") + distance).alias("up"), F.col("to").alias("id"))
        ways, _ = cut(ways.unionByName(onward))
        jump_, _ = cut(jump_.alias("a").join(jump_.alias("b"), F.col("a.to") == F.col("b.at")).select(F.col("a.at").alias("at"), F.col("b.to").alias("to")))
        distance *= 2
    depth = ways.groupBy("leaf").agg(F.max("up").alias("depth"))
    return ways.join(depth, "leaf").select("conversation_id", "leaf", (F.col("depth") - F.col("up") + 1).alias("step"), "id")


@tidy
def conversations(emails: DataFrame, sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, parent, root, conversation_id, orphan, backward, cycle, turn, speaker, kept) for every message.

    ``parent`` is the message cited last, ``root`` the end of its chain, ``orphan`` a citation of a message that is not
    there, ``backward`` a parent sent later than its reply (the only links that can close a cycle), ``cycle`` one that
    does close one. ``kept`` tells
    whole conversations (two messages or more, nothing missing, unreadable or blank, both speakers) from broken ones.
    Messages with the same own id are all cited by that id: the smallest one stands for them, and the others are linked to
    it where any message cites the id, so n owners and m citations give n + m links. An empty table gives an empty result.
    """
    base, _ = cut(messages(emails, sources, accounts))
    cites = base.select("id", "sent_us", F.posexplode("cited").alias("at", "own"))
    # of the owners of an id the smallest stands for all, since one of them may cite it itself the second smallest is kept too
    owned = base.where("own is not null")
    first = owned.groupBy("own").agg(F.min(F.struct("id", "sent_us")).alias("f"), F.count("*").alias("n"))
    others = owned.join(first.where("n > 1").select("own", F.col("f.id").alias("least")), "own").where("id <> least")
    second = others.groupBy("own").agg(F.min(F.struct("id", "sent_us")).alias("s"))
    owners = first.join(second, "own", "left").select("own", "f", "s")
    best = F.when(F.col("f.id") == F.col("id"), F.col("s")).otherwise(F.col("f"))
    links = cites.join(owners, "own", "left").withColumn("o", best).where("f is null or o is not null")
    links, _ = cut(links.select("id", "own", "sent_us", "at", F.col("o.id").alias("target"), F.col("o.sent_us").alias("target_us")))
    twins = others.join(cites.select("own").distinct(), "own", "left_semi").select("id", F.col("least").alias("target"))
    later = F.struct(F.coalesce("target_us", "sent_us", F.lit(0)), "target") > F.struct(F.coalesce("sent_us", "target_us", F.lit(0)), "id")
    own_cited = cites.join(base.select("id", "own"), ["id", "own"], "left_semi").select("id", "own")
    lost = links.where("target is null").join(own_cited, ["id", "own"], "left_anti")
    nearest = links.where("target is not null").groupBy("id").agg(F.max_by(F.struct("target", later.alias("backward")), F.struct("at", -F.col("target"))).alias("p"))
    parents = nearest.select("id", F.col("p.target").alias("parent"), F.col("p.backward").alias("backward"))
    parents, _ = cut(parents)
    roots, _ = cut(jump(parents.where("not backward"), "id", "parent").withColumnRenamed("parent", "root"))
    keyed = base.where("key is not null").select("key", "id")
    smallest = keyed.groupBy("key").agg(F.min("id").alias("target"), F.count("*").alias("n")).where("n > 1")
    more = links.where("target is not null").select("id", "target").unionByName(twins).unionByName(keyed.join(smallest, "key").select("id", "target"))
    to = lambda c, n: roots.select(F.col("id").alias(c), F.col("root").alias(n))
    between = more.join(to("id", "a"), "id", "left").join(to("target", "b"), "target", "left")
    closing, _ = cut(cycles(parents.where("backward").select("id", "parent"), roots))
    trees = connected_components(between.select(F.coalesce("a", "id").alias("src"), F.coalesce("b", "target").alias("dst")))
    # a tree's root need not be its smallest member, so the conversation is named last
    rows = base.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(trees.withColumnRenamed("node", "root"), "root", "left")
    rows = rows.join(closing.withColumn("cycle", F.lit(True)), "id", "left").join(parents, "id", "left").join(lost.select("id").distinct().withColumn("orphan", F.lit(True)), "id", "left")
    rows = rows.select("id", "parent", "root", F.coalesce("component", "root").alias("c"), F.coalesce("orphan", F.lit(False)).alias("orphan"),
                       F.coalesce("backward", F.lit(False)).alias("backward"), F.coalesce("cycle", F.lit(False)).alias("cycle"), "sent_us", "blank", "outgoing", F.floor(F.col("sent_us") / DAY_US).alias("day"))
    rows, _ = cut(rows)
    whole = rows.groupBy("c").agg(
        F.min("id").alias("conversation_id"),
        ((F.count("*") >= 2) & ~F.bool_or("orphan") & (F.count("sent_us") == F.count("*")) & ~F.bool_or("blank") & F.bool_or("outgoing") & F.bool_or(~F.col("outgoing"))).alias("kept"),
    )
    # turns: ranks within a day plus the messages of the days before, so no task sorts a whole conversation
    days = rows.groupBy("c", "day").agg(F.count("*").alias("n"))
    before = days.select("c", "day", (F.sum("n").over(Window.partitionBy("c").orderBy(F.col("day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("c", "day").orderBy(F.col("sent_us").asc_nulls_last(), "id"))
    rows = rows.withColumn("rank", rank).withColumn("day", F.coalesce("day", F.lit(1 << 40)))
    rows = rows.join(before.withColumn("day", F.coalesce("day", F.lit(1 << 40))), ["c", "day"]).join(whole, "c")
    speaker = F.when(F.col("outgoing"), "outgoing").otherwise("incoming")
    return rows.select("id", "parent", "root", "conversation_id", "orphan", "backward", "cycle", (F.col("before") + F.col("rank")).alias("turn"), speaker.alias("speaker"), "kept")
