"""Link variant spellings of persons and firms (problem 2).

Names are parsed into what identifies them: given name and surname of a person, proper word and line of business of a
firm; titles, legal forms, order, case and accents are dropped. Candidates meet in blocks of token suffixes: every
suffix of at least SUFFIX letters of the identifying word, and its first letters (a slip near the end of a word leaves no
common suffix). A common suffix keeps all its names: it is divided into parts of which every two meet. Inside a block
words that differ by one letter find each other by what is left without it, given names also by their short forms and
initials, and are compared by the ratio of their longest common subsequence; only links are emitted, from each name to the first one it matches. Two spellings that both stand in
mail addresses are different names, however alike. Names with an initial only join the one person they fit best.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carteggio.llm.pii import fold, senders
from carteggio.operators.graph import connected_components
from carteggio.session import cut, tidy

#: Least suffix, names in a part of a block, least ratio.
SUFFIX, PART, RATIO = 4, 4096, 0.8
#: Surnames under which two given names must share a personal address to be short forms of one; given names that such an
#: address may have before it counts as shared by several people.
SUPPORT, PERSONAL = 3, 5

# Lines of business, legal forms, titles, words of offices, short forms of given names.
BUSINESS = ("costruzioni", "trasporti", "recuperi", "industrie", "servizi", "impianti", "logistica", "ambiente", "engineering", "laboratori", "consulting", "ecologia", "chimica", "energia")
LEGAL = re.compile(r"(?<![^\W_])(?:s\.?\s?r\.?\s?l\.?s?|s\.?\s?p\.?\s?a|s\.?\s?n\.?\s?c|s\.?\s?a\.?\s?s|g\.?\s?m\.?\s?b\.?\s?h|ltd|limited|inc|llc|a\.?g|k\.?g|s\.a|s\.l)\.?(?![^\W_])", re.I)
TITLES = frozenset("ing dott dottssa ssa dr geom arch avv rag prof sig sigra mr mrs ms herr frau mme mlle dssa spettle spett le ditta per pi".split())
OFFICES = frozenset("""amministrazione segreteria ufficio info tecnico notifiche ambiente laboratorio studio acquisti commerciale direzione office admin contabilita
    service support noreply reply no posta pec sales kundendienst buero buro comptabilite administracion oficina""".split())  # fmt: skip
SHORT = {
    "alessandro": "ale sandro alex", "antonio": "tonino toni tonio nino", "benoit": "ben", "chiara": "chiaretta", "dolores": "lola", "domenico": "mimmo menico", "edward": "ted ned ed eddie",
    "elisabetta": "betta elisa lisa", "elizabeth": "liz beth betty eliza", "filomena": "mena filo", "francesco": "cesco franco checco", "francisca": "paca paqui", "frederic": "fred", "friedrich": "fritz fred friedel",
    "genevieve": "ginette gene", "giovanni": "gianni nanni vanni", "giuseppe": "pino beppe peppe", "harriet": "hattie harry", "helene": "lena leni", "ignacio": "nacho", "ilaria": "ila lari", "james": "jim jimmy jamie",
    "johannes": "hannes hans jo", "jose maria": "chema josema", "jurgen": "jurg", "katharina": "kathe kati katrin", "katherine": "kate kathy kat", "lucia": "lucy lu", "luigi": "gigi gino", "marco": "marchino",
    "margaret": "maggie peggy meg", "margherita": "rita marghe", "marguerite": "margot", "niccolo": "nico nicco", "ottavia": "otti tavia", "pamela": "pam", "raffaella": "lella raffa", "robert": "bob rob bobby",
    "roberto": "berto robi rob", "sebastian": "basti seb", "ubaldo": "baldo ubi", "ulrike": "uli ulli rike", "vincenzo": "enzo vince", "william": "bill will willy", "zeno": "zenone",
}
LONG: dict[str, set[str]] = defaultdict(set)
for _g, _s in SHORT.items():
    LONG[_g].add(_g)
    for _n in _s.split():
        LONG[_n].add(_g)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if a == b:
        return len(a)
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            now = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(now, row[j])
            last = now
    return i + row[-1]


def alike(a: str, b: str) -> bool:
    """Equal but for one slip: subsequence ratio of at least RATIO and at most one letter of the longer word missing."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    n = lcs(a, b)
    return n >= max(len(a), len(b)) - 1 and 2 * n / (len(a) + len(b)) >= RATIO


class Words:
    """What is known of the words of one name: given names with their number, words that stand in addresses, slips of given names."""

    def __init__(self, given: dict[str, int], attested: frozenset, slips: dict[str, str] | None = None):
        self.given, self.attested, self.slips = given, attested, slips or {}

    def as_given(self, w: str) -> str:
        """The given name ``w`` is, but for one slip; empty if none."""
        return w if w in self.given else self.slips.get(w, "")


SHORT_WORDS = sorted({w for k in LONG for w in k.split()})


def tokens(name: str) -> set[str]:
    """All words that :func:`parse` may ask about."""
    bare = name.replace("'", "").replace("’", "")
    return {fold(w) for text in (name, bare, LEGAL.sub(" ", name), LEGAL.sub(" ", bare)) for w in re.findall(r"[^\W\d_]+", text)}


def parse(name: str | None, firm: bool | None, words: Words) -> tuple[str, str, str] | None:
    """(kind, other, main): ``p``, given name or initial, surname; or ``f``, line of business, proper word.

    ``firm`` is None where the name itself must tell. Null, empty, numeric and office names give None, as do single
    words that could be anything.
    """
    if not name:
        return None
    text = LEGAL.sub(" ", name)
    legal = text != name
    tokens = [fold(w) for w in re.findall(r"[^\W\d_]+", text.replace("'", "").replace("’", ""))]
    tokens = [w for w in tokens if w not in TITLES]
    if not tokens:
        return None
    business = [b for w in tokens for b in BUSINESS if w == b or len(w) > 4 and alike(w, b) or 3 <= len(w) < len(b) and b.startswith(w) and w not in words.given]
    if firm is None:
        known = any(w in words.given for w in tokens)
        firm = legal or bool(business) and not (known and re.search(r"[(\-–]", name)) and not (known and len(tokens) > 2)
        if all(w in OFFICES for w in tokens):
            return None
    if firm:
        used = next(((w, b) for w in tokens for b in BUSINESS if w == b), None) or next(((w, b) for w in tokens for b in BUSINESS if len(w) > 4 and alike(w, b) or 3 <= len(w) < len(b) and b.startswith(w)), None)
        core = [w for w in tokens if len(w) > 1 and not (used and w == used[0])]
        return ("f", used[1] if used else "", " ".join(core)) if core else None
    person = re.split(r"\s[-–]\s|\(", name)[0] if re.match(r"\s*\S.*(?:\s[-–]\s|\()", name) else name
    comma = "," in person
    tokens = [fold(w) for w in re.findall(r"[^\W\d_]+", person.replace("'", "").replace("’", ""))]
    tokens = [w for w in tokens if w not in TITLES]
    full, initials = [w for w in tokens if len(w) > 1], [w for w in tokens if len(w) == 1]
    if not full or len(full) > 4 and not any(w in words.given for w in full):  # many words without a given name are no person
        return None
    if len(full) == 1:
        return ("p", initials[0], full[0]) if initials and not words.as_given(full[0]) == full[0] else None
    exact = [w for w in full if w in words.given]
    if len(exact) == len(full):  # all could be given names
        exact = [full[-1]] if comma else exact[:-1]
    if not exact:
        near = [w for w in full if words.as_given(w)]
        exact = near[:1] or ([full[-1]] if comma else full[:1])
    rest = [w for w in full if w not in exact]
    given = " ".join(words.as_given(w) or w for w in exact)
    return ("p", given, " ".join(rest)) if rest else None


def fit(a: tuple[str, str], b: tuple[str, str], kind: str, given: tuple[bool, bool], attested: tuple[bool, bool], kin: tuple[tuple, tuple] = ((), ())) -> bool:
    """Whether (other, main) of two names of one kind may be the same; ``given`` and ``attested`` tell which of the two
    given names and of the two surnames (or proper words) are known as such, ``kin`` the learned pairs they stand in."""
    (x, p), (y, q) = a, b
    if kind == "f":
        if x != y:
            return False
    elif x != y:
        gx, gy = LONG.get(x, {x}) | set(kin[0]), LONG.get(y, {y}) | set(kin[1])
        if not (gx & gy) and all(given) or not (gx & gy) and not alike(x, y):
            return False
    return p == q or not all(attested) and alike(p, q)


def slips(w: str) -> set[str]:
    """``w`` and what is left of it without one letter: two words that are :func:`alike` share one of these."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) > 3 else {w}


def near(words: Iterable[str]) -> Iterator[tuple[str, str]]:
    """All pairs of equal or alike words, each once, without comparing every two."""
    seen = defaultdict(list)
    for q in sorted(words):
        others = set()
        for v in slips(q):
            others.update(seen[v])
            seen[v].append(q)
        yield q, q
        yield from ((p, q) for p in sorted(others) if alike(p, q))


@lru_cache(maxsize=100_000)
def traits(other: str, kind: str, kin: tuple = ()) -> tuple[frozenset, frozenset]:
    """What a given name (or line of business) is filed under and looked up by: names that may fit share one of these."""
    if kind == "f" or len(other) == 1:
        return frozenset(("=" + other, "l" + other)), frozenset(("=" + other, "w" + other))
    full = {"=" + v for v in slips(other)} | {"~" + g for g in (*LONG.get(other, ()), *kin)}
    initials = {g[:1] for g in (other, *LONG.get(other, ()))}
    return frozenset(full | {"w" + x for x in initials}), frozenset(full | {"l" + x for x in initials})


def slip_keys(c: Column) -> Column:
    """:func:`slips` as an array column: two different words are alike if they share one and are long enough."""
    n = F.length(c)
    cut_ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), F.when(n > 3, cut_).otherwise(F.array().cast("array<string>"))))


def alike_column(a: Column, b: Column) -> Column:
    """:func:`alike` of two different words that share a slip key."""
    return (a != b) & (F.least(F.length(a), F.length(b)) >= 4) & ((F.length(a) != F.length(b)) | (F.length(a) >= 5))


def known_words(emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) of given names and (word) of words that stand in addresses, learned from the header fields.

    A learned given name that is a slip of one more than five times as frequent, or of one of the short forms listed, is
    none of its own; the listed ones count once where none is learned. Tables: nothing is collected or cut.
    """
    spark = emails.sparkSession
    found, _ = cut(senders(emails).where("role = 'surname' or n > 1"))
    surnames = found.where("role = 'surname'").select("word").distinct()
    domains = emails.select(F.explode(F.regexp_extract_all(F.lower("sender"), F.lit(r"@([a-z]{4,})[.\-]"), 1)).alias("word")).distinct()
    attested, _ = cut(surnames.unionByName(domains).distinct())
    given = found.where((F.col("role") == "given") & (F.col("n") > 2) & ~F.col("word").isin(*OFFICES, *BUSINESS)).join(surnames, "word", "left_anti").select("word", "n")
    given, _ = cut(given)
    listed = spark.createDataFrame([(w,) for w in SHORT_WORDS], "word string")
    whole = spark.createDataFrame([(w,) for w in sorted(LONG)], "word string")
    keyed = given.select("word", "n", F.explode(slip_keys(F.col("word"))).alias("key"))
    near = lambda other: keyed.join(other.select(F.col("word").alias("w"), "m", F.explode(slip_keys(F.col("word"))).alias("key")), "key").where(alike_column(F.col("word"), F.col("w")) & (F.length("w") > 3))
    lesser = near(given.withColumn("m", F.col("n"))).where("m > 5 * n").select("word")
    slip = near(whole.withColumn("m", F.lit(0))).select("word").join(whole, "word", "left_anti")
    kept = given.join(lesser.unionByName(slip).distinct(), "word", "left_anti").withColumn("n", F.col("n").cast("long"))
    kept, _ = cut(kept.unionByName(listed.join(kept, "word", "left_anti").withColumn("n", F.lit(1).cast("long"))))
    return kept, attested


def short_forms(parsed: DataFrame, mails: DataFrame) -> DataFrame:
    """(other, kin): given names that are forms of one another, learned from addresses; ``kin`` names their pairs.

    An address whose user part holds the surname is personal. Two given names that are no slips of each other and stand
    before the same personal addresses under SUPPORT different surnames are forms of one name. An address with
    more than PERSONAL given names tells nothing: people of one surname share it.
    """
    people = parsed.where("kind = 'p' and firm is null and length(other) > 1").select("name", "other", "main")
    used = mails.where("address is not null").select("name", "address").distinct().join(people, "name")
    used = used.withColumn("parts", F.split(F.split_part("address", F.lit("@"), F.lit(1)), "[^a-z]+")).where(F.array_contains("parts", F.col("main")))
    initial = F.coalesce(F.get(F.filter("parts", lambda x: F.length(x) == 1), F.lit(0)), F.lit(""))
    used = used.select("address", "main", initial.alias("initial"), "other").distinct()
    few = used.groupBy("address", "main").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= PERSONAL)).select("address", "main")
    used, _ = cut(used.join(few, ["address", "main"]))
    a, b = used.select("address", "main", "initial", F.col("other").alias("x")), used.select("address", "main", F.col("other").alias("y"))
    pairs = a.join(b, ["address", "main"]).where((F.col("x") < F.col("y")) & (F.levenshtein("x", "y") > 2))
    pairs = pairs.where((F.col("initial") == "") | (F.col("initial") == F.substring("x", 1, 1)) | (F.col("initial") == F.substring("y", 1, 1)))
    good = pairs.groupBy("x", "y").agg(F.countDistinct("main").alias("n")).where(F.col("n") >= SUPPORT).select("x", "y", F.concat_ws("|", "x", "y").alias("pair"))
    return good.select(F.explode(F.array("x", "y")).alias("other"), "pair").groupBy("other").agg(F.array_sort(F.collect_set("pair")).alias("kin"))


def named(emails: DataFrame) -> DataFrame:
    """(id, name, address) of the senders that have a name and not only an address; address is null if there is none."""
    s = F.trim("sender")
    name = F.when(s.rlike(r"^[^(]*@[^(]*\(.*\)\s*$"), F.regexp_extract(s, r"\((.*)\)\s*$", 1)).otherwise(F.regexp_replace(s, r"<[^>]*>?|\S+@\S+", " "))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"[\"“”]", " "), r"\s+", " "))
    address = F.nullif(F.regexp_extract(F.lower("sender"), r"([^\s<>()\"',;:@]+@[^\s<>()\"',;:@]+)", 1), F.lit(""))
    return emails.select("id", name.alias("name"), address.alias("address")).where(r"name rlike '\\p{L}{2}'")


@tidy
def link(entities: DataFrame, emails: DataFrame) -> DataFrame:
    """(record_type, record_id, entity_id) for every linked row.

    ``entity`` rows are the entities of type person, client or supplier other than the smallest id of their name,
    ``email`` rows the messages whose sender's name denotes a listed one. Null, empty and office names link to
    nothing, repeated rows each get their link.
    """
    spark = entities.sparkSession
    listed = entities.where(F.col("entity_type").isin("person", "client", "supplier") & F.col("display_name").isNotNull())
    rows = listed.select(F.lit("entity").alias("record_type"), F.col("id").alias("record_id"), F.trim("display_name").alias("name"), (F.col("entity_type") != "person").alias("firm"))
    typed, _ = cut(named(emails))
    mails = typed.select(F.lit("email").alias("record_type"), F.col("id").alias("record_id"), "name", F.lit(None).cast("boolean").alias("firm"))
    rows, _ = cut(rows.unionByName(mails))
    given, attested = known_words(emails)
    # few bytes but much work a name, so the tasks are set by cores and not by size
    spread, _ = cut(rows.select("name", "firm").distinct().repartition(2 * spark.sparkContext.defaultParallelism, "name"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(n, w) for n in b.column(0).to_pylist() for w in tokens(n)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], ["name", "word"])

    asked, _ = cut(spread.select("name").distinct().mapInArrow(ask, "name string, word string"))
    # what is known of every word, by joins on words and on what slips leave of them
    words = asked.select("word").distinct().join(given, "word", "left").join(attested.withColumn("attested", F.lit(True)), "word", "left")
    words, _ = cut(words.select("word", "n", F.coalesce("attested", F.lit(False)).alias("attested")))
    loose = words.where("n is null and not attested and length(word) >= 5").select("word", F.explode(slip_keys(F.col("word"))).alias("key"))
    nearest = loose.join(given.where("length(word) > 3").select(F.col("word").alias("g"), F.col("n").alias("m"), F.explode(slip_keys(F.col("word"))).alias("key")), "key").where(alike_column(F.col("word"), F.col("g")))
    nearest = nearest.groupBy("word").agg(F.max(F.struct("m", "g"))["g"].alias("near"))
    known = words.join(nearest, "word", "left").where("n is not null or attested or near is not null")
    of = asked.join(known, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n", "attested", "near")).alias("known"))  # the words of one name

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, f, k in zip(*(b.column(i).to_pylist() for i in range(3))):
                k = k or []
                found.append(parse(n, f, Words({x["word"]: x["n"] for x in k if x["n"]}, frozenset(x["word"] for x in k if x["attested"]), {x["word"]: x["near"] for x in k if x["near"]})))
            columns = [pa.array([f and f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["name", "firm", "kind", "other", "main"])

    spread = spread.join(of, "name", "left").select("name", "firm", "known").repartition(2 * spark.sparkContext.defaultParallelism, "name")
    parsed = spread.mapInArrow(read, "name string, firm boolean, kind string, other string, main string").where("kind is not null")
    parsed, _ = cut(parsed.withColumn("node", F.concat_ws("|", "kind", "other", "main")))
    nodes = parsed.select("node", "kind", "other", "main").distinct()
    flag = lambda df, c, n: df.select(F.col("word").alias(c), F.lit(True).alias(n))
    kin, _ = cut(short_forms(parsed, typed))
    nodes = nodes.join(kin, "other", "left").join(flag(given, "other", "given"), "other", "left").join(flag(attested, "main", "attested"), "main", "left")
    nodes, _ = cut(nodes.select("node", "kind", "other", "main", F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("attested", F.lit(False)).alias("attested"), F.coalesce("kin", F.array().cast("array<string>")).alias("kin")))
    n = lambda c: F.length(c)
    tails = lambda c, least: F.transform(F.sequence(F.lit(1), F.greatest(n(c) - (least - 1), F.lit(1))), lambda i: F.substr(F.col(c), i))
    begin = F.concat_ws(":", F.when(F.col("kind") == "f", F.col("other")), F.substring("main", 1, 3))
    keyed = nodes.select(*nodes.columns, F.explode(F.transform(tails("main", SUFFIX), lambda x: F.concat_ws("/", F.lit("m"), F.col("kind"), x))).alias("s"))
    keyed = keyed.unionByName(nodes.select(*nodes.columns, F.concat_ws("/", F.lit("o"), F.col("kind"), begin).alias("s")))
    # a crowded block is divided into parts, every two of which meet: who meets whom does not depend on its size
    keyed, _ = cut(keyed.select(F.xxhash64("s").alias("block"), *nodes.columns).distinct())
    crowded = keyed.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    placed = keyed.join(crowded, "block", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    blocks = placed.select(F.xxhash64("block", F.least("part", "with"), F.greatest("part", "with")).alias("block"), *nodes.columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from carteggio.llm.clusters import _batches

        for t in _batches(batches, "block"):
            c = t.to_pydict()
            c["kin"] = [tuple(k) for k in c["kin"]]
            out: list[tuple[str, str, bool]] = []
            groups = defaultdict(list)
            for i, k in enumerate(c["block"]):
                groups[k].append(i)
            for members in groups.values():
                if len(members) < 2:
                    continue
                mains = defaultdict(list)
                for i in members:
                    mains[c["main"][i]].append(i)
                slots = {p: defaultdict(list) for p in mains}
                for p, those in mains.items():
                    for i in those:
                        for k in traits(c["other"][i], c["kind"][i], c["kin"][i])[0]:
                            slots[p][k].append(i)
                for p, q in near(mains):
                    met = {(i, j) for i in mains[p] for k in traits(c["other"][i], c["kind"][i], c["kin"][i])[1] for j in slots[q].get(k, ()) if (p != q or i < j) and c["kind"][i] == c["kind"][j]}
                    for i, j in sorted(met):
                        a, b = c["other"][i], c["other"][j]
                        short = c["kind"][i] == "p" and (len(a) == 1 or len(b) == 1)
                        if short and len(a) != len(b):
                            letter, whole = (a, b) if len(a) == 1 else (b, a)
                            if any(g[0] == letter for g in {whole, *LONG.get(whole, ())}) and (p == q or not (c["attested"][i] and c["attested"][j])):
                                out.append((c["node"][i], c["node"][j], True))
                        elif fit((a, p), (b, q), c["kind"][i], (c["given"][i], c["given"][j]), (c["attested"][i], c["attested"][j]), (c["kin"][i], c["kin"][j])):
                            out.append((c["node"][i], c["node"][j], False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([o[2] for o in out])], ["src", "dst", "initial"])

    links = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "src string, dst string, initial boolean").distinct()
    links, _ = cut(links)
    whole = connected_components(links.where("not initial"))
    named_by = nodes.join(whole, "node", "left").select("node", "other", F.coalesce("component", "node").alias("group"))
    used = rows.groupBy("name", "firm").agg(F.count("*").alias("n"))
    used = parsed.select("name", "firm", "node").join(used, (used.name == parsed.name) & used.firm.eqNullSafe(parsed.firm)).groupBy("node").agg(F.sum("n").alias("n"))
    grouped = named_by.join(used, "node", "left")
    support = grouped.groupBy("group").agg(F.sum("n").alias("support"))
    ends = links.where("initial").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    short = ends.join(nodes.where("length(other) = 1").select(F.col("node").alias("a"), F.col("main").alias("am")), "a")
    short = short.join(named_by.select(F.col("node").alias("b"), "group"), "b").join(nodes.select(F.col("node").alias("b"), F.col("main").alias("bm")), "b").join(support, "group")
    best = short.groupBy("a").agg(F.max_by("group", F.struct((F.col("am") == F.col("bm")).alias("same"), "support", "group")).alias("joined"))
    final = named_by.join(best.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("joined", "group").alias("group"))
    of = rows.join(parsed.select(F.col("name").alias("n2"), F.col("firm").alias("f2"), "node"), (F.col("name") == F.col("n2")) & F.col("firm").eqNullSafe(F.col("f2"))).join(final, "node")
    of, _ = cut(of.select("record_type", "record_id", "group"))
    smallest = of.where("record_type = 'entity'").groupBy("group").agg(F.min("record_id").alias("entity_id"))
    return of.join(smallest, "group").where("record_type = 'email' or record_id <> entity_id").select("record_type", "record_id", "entity_id")
