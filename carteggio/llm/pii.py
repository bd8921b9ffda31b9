"""Personal information in free text (problem 5).

Bootstrapped contextual extraction. Seeds are entities of unmistakable form: names and addresses of the header fields,
numbers with a country prefix, identity numbers of known make. Around every candidate (a capitalised word, a run of
digits and letters) the word before it is its pattern; Spark counts pattern-instance edges over the whole corpus and
scores both sides of that graph in turns: a pattern by the share of its occurrences whose instance is known, an
instance by its patterns. Confident patterns then admit instances no seed covers (nicknames, surnames, bare digit
runs, other document numbers). The last pass marks every occurrence with the seeds' forms, the learned words and
the learned patterns, and replaces it by a typed placeholder.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carteggio.session import cut, tidy

#: Words and patterns that may be broadcast at most, rounds of scoring, least score and occurrences of a pattern.
MOST, ROUNDS, CONFIDENT, OFTEN = 1_000_000, 3, 0.7, 5
FIELDS = ("subject", "body_plain")

# Words of firms, titles before names, openings that are no names, words of streets.
FIRM = frozenset("""costruzioni trasporti recuperi industrie servizi impianti logistica ambiente engineering laboratori costr trasp rec ind serv imp log amb
    eng lab srl spa snc sas gmbh ltd limited spa ag kg sa sl inc llc studio consulting holding group srls""".split())  # fmt: skip
OPEN = frozenset("""caro cara cari ciao gentile gentili egregio egregia salve buongiorno buonasera spettabile hallo hello hi liebe lieber liebes dear good guten sehr
    cher chère madame monsieur bonjour hola estimado estimada querido querida buenos buenas señor señora signor signora ing dott dottssa dr geom arch rag avv prof
    sig sigra mr mrs ms herr frau frl mme mlle don doña morning afternoon evening tag abend geehrter geehrte días tardes oggetto subject betreff objet asunto
    da from von de re fw fwd aw rif tr sirs sir madam damen herren ditta all team tutti studio messieurs mesdames señores colleghi
    amministrazione ufficio segreteria info tecnico office grüße grusse gruße saluti saluto regards cheers saludos salutations grazie thanks cordialmente cordialement""".split())  # fmt: skip
TITLE = r"(?:ing|dott|dott\.ssa|dr|dr\.ssa|geom|arch|rag|avv|prof|sig|sig\.ra|sig\.na|mr|mrs|ms|herr|frau|mme|mlle|sr|sra|p\.i)"
_GAP = r"(?:[ \t]+|[ \t]*\r?\n(?:[A-Z]{0,3}[>|][ \t]?)*[ \t]*)"
_UP = "A-ZÀ-ÖØ-ÞĀ-Ž"
_PART = rf"(?:(?:de|del|della|delle|dei|degli|di|la|le|los|las|du|des|d|dell|san|santa|sant|sur|the)\b['’]?|[{_UP}][\w'’.-]*)"
_WORDS = rf"{_PART}(?:{_GAP}?{_PART}){{0,5}}?"
_STREET = (
    # words that open an address, with what may follow; and addresses found around a word of theirs
    (("via ", "via\n", "via\r", "viale", "v.le", "piazza", "p.zza", "corso", "c.so", "largo", "loc.", "località", "strada", "vicolo", "contrada", "c.da"),
     rf"(?i:via|viale|v\.le|piazza|p\.zza|piazzale|corso|c\.so|largo|loc\.|località|strada|vicolo|contrada|c\.da){_GAP}{_WORDS},?{_GAP}?(?:(?i:n)\.?{_GAP})?\d{{1,4}}\b(?!\.?\d)"),
    (("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino", "ronda"),
     rf"(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda){_GAP}?{_WORDS},?{_GAP}(?:nº{_GAP}?)?\d{{1,4}}\b"),
    (("Am ", "An der", "Im ", "In der", "Zum ", "Zur ", "Auf de"), rf"(?:Am|An{_GAP}der|Im|In{_GAP}der|Zum|Zur|Auf{_GAP}de[mr]){_GAP}[{_UP}][\w-]+{_GAP}\d{{1,4}}[a-z]?\b(?![.:]\d)"),
)
_AROUND = (
    (("lane", "road", "street", "st.", "st,", "close", "rd", "avenue", "ave", "drive", "way", "square", "court", "terrace", "crescent", "gardens"),
     rf"(?<!\w)(?:(?i:flat|apt\.?|unit){_GAP}\d+[A-Za-z]?,{_GAP})?\d{{1,4}}[A-Za-z]?{_GAP}(?:[{_UP}][\w'’]+{_GAP}){{1,3}}(?:Lane|Road|Street|St\b|Close|Rd\b|Avenue|Ave\b|Drive|Way|Square|Court|Terrace|Crescent|Gardens)"),
    (("rue", "avenue", "chemin", "place", "impasse", "allée", "boulevard", "quai", "route"),
     rf"(?<!\w)\d{{1,4}}(?:{_GAP}(?:bis|ter|quater))?,?{_GAP}(?:rue|avenue|chemin|place|impasse|allée|boulevard|quai|route){_GAP}(?:(?:de|du|des|la|le|les|l|d)\b['’]?{_GAP}?){{0,2}}[{_UP}][\w'’-]+"),
    (("str.", "straße", "strasse", "weg", "gasse", "platz", "allee"), rf"(?<!\w)[{_UP}][\w-]*(?:str\.|straße|strasse|weg|gasse|platz|allee){_GAP}\d{{1,4}}[a-z]?\b(?![.:]\d)"),
)
#: White space beside a word of ``_AROUND`` as it stands in an address; where there is none, no such address is near.
_SIGN = re.compile(
    r"[ \t\r\n>|](?:(?=[ \t\r\n>|A-Z\d])(?<=(?:str\.|raße|asse|.weg|latz|llee)[ \t\r\n>|])"
    r"|(?=[A-Z])(?:Lane|Road|Street|St|Close|Rd|Ave|Drive|Way|Square|Court|Terrace|Crescent|Gardens)"
    r"|(?=[abcipqr])(?:rue|avenue|chemin|place|impasse|allée|boulevard|quai|route)(?=[ \t\r\n]))"
)
_STREET = tuple((keys, re.compile(rule)) for keys, rule in _STREET)
_AROUND = tuple((keys, re.compile(rule)) for keys, rule in _AROUND)
EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*+(?:@|[ \t]?[\[({][ \t]?(?:at|AT|chiocciola|@)[ \t]?[\])}][ \t]?|[ \t]@[ \t])[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_AT = ("@", "[at]", "(at)", "{at}", "[AT]", "(AT)", "[ at", "( at", "chiocciola")
ID = re.compile(
    rf"(?<![\w./-])(?:[A-Za-z]{{6}}\d\d[A-Za-z]\d\d[A-Za-z]\d{{3}}[A-Za-z]|[A-Za-z]{{3}} [A-Za-z]{{3}} \d\d[A-Za-z]\d\d [A-Za-z]\d{{3}}[A-Za-z]|756[.]\d{{4}}[.]\d{{4}}[.]\d\d"
    rf"|[A-CEGHJ-PR-TW-Za-ceghj-pr-tw-z][A-Za-z]{_GAP}?\d\d{_GAP}?\d\d{_GAP}?\d\d{_GAP}?[A-Da-d]|[Qq][Qq]{_GAP}?\d\d{_GAP}?\d\d{_GAP}?\d\d{_GAP}?[A-Da-d]|\d{{8}}-?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z]"
    rf"|[12] \d\d (?:0[1-9]|1[0-2]) \d[\dAB] \d{{3}} \d{{3}}(?: \d\d)?)(?![\w/-])"
)
_SEP = r"[ \t.\-/]?"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:(?:\+|00)\d{{1,3}}(?:{_GAP}|[.\-/])?(?:\(\d{{1,4}}\)(?:{_GAP}|[.\-/])?)?\d{{1,5}}(?:(?:{_GAP}|[.\-/])?\d{{1,8}}){{1,5}}"
    rf"|\(0?\d{{2,5}}\)(?:{_GAP}|[.\-/])?\d{{2,8}}(?:(?:{_GAP}|-)\d{{2,5}}){{0,3}}|0\d{{1,4}}[/\-]\d{{3,8}}(?:{_GAP}\d{{2,4}}){{0,3}}|0\d{{1,4}} \d{{5,8}}|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}})(?![\w/]|[.,-]\d)"
)
#: What else may be a phone or an identity number, if its patterns say so.
CODE = re.compile(r"(?<![\w./+-])(?=[A-Za-z]{0,4}\d)[A-Za-z0-9]{7,16}(?![\w/]|[.,-]\d|@)")
#: ``id``, ``phone`` and other codes by group, the first that fits.
_FORM = re.compile(f"({ID.pattern})|({PHONE.pattern})|({CODE.pattern})")
#: The first digit of a number that one of these forms may hold: after a sign, long enough or divided like one, after letters.
_DIGITS = re.compile(
    r"\d(?:(?<=[+(]\d)|(?<![\w./+(-]\d)(?:(?=[A-Za-z\d]{6}|\d\d[.\-]\d{3})|(?<=0)(?=0\d|\d{1,4}[/\- ]\d{3})|(?<=[12])(?= \d\d ))"
    r"|(?<=[A-Za-z]\d)(?=[A-Za-z\d])|(?<=[A-Z][A-Z][ \t\n]\d)(?=\d))"
)
WORD = re.compile(rf"[{_UP}][\w'’]+")
#: A capitalised word, or what begins like a number, and the word before it; a word is tried from its first character only.
_PAIR = re.compile(rf"(?<!\S)(\S++)[ \t]++(?=([{_UP}][a-zß-ÿ'’]+[a-zß-ÿ])(?![\w@]))")


def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def shape(code: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", code))


@lru_cache(maxsize=100_000)
def _pattern(before: str) -> str:
    s = re.sub(r"\d+", "9", before.strip("\"'«»“”*_").lower())
    return s[-24:] or "|"


def pattern_of(word: str, known=frozenset()) -> str:
    """The pattern a preceding word stands for: ``|`` for marks at the start of a line, ``N`` for known names."""
    if not word.strip(">|*"):
        return "|"
    bare = fold(word.rstrip(",:;."))
    if bare in known:
        return "N" + (word[-1] if word[-1] in ",:;" else "")
    return _pattern(word)


def before(text: str, at: int) -> str:
    """The word before a position on its line; empty at the start of the line."""
    z = at
    while z and text[z - 1] in " \t":
        z -= 1
    low = max(0, z - 64)
    word = text[text.rfind(" ", low, z) + 1 or low : z]
    if not word.isprintable():  # other white space, or nothing of the kind
        word = word[max(map(word.rfind, "\n\t\r\xa0")) + 1 :]
    return word


def starts(text: str) -> Iterator[int]:
    """Where a phone, an identity number or another code may begin: a digit run, or the letters or sign before it."""
    for m in _DIGITS.finditer(text):
        a = m.start()
        p = a
        while p and a - p < 7 and text[p - 1].isalpha():
            p -= 1
        if p == a and a:
            c = text[a - 1]
            if c in "+(":
                p = a - 1
            elif c in " \t\n" and a > 2 and text[a - 3 : a - 1].isalpha() and text[a - 3 : a - 1].isupper() and (a == 3 or not text[a - 4].isalnum()):
                yield a - 3
        if not (p and (text[p - 1].isalnum() or text[p - 1] in "_./+-")):
            yield p


def code_kind(text: str, at: int) -> tuple[str, int]:
    """(``id``, ``phone``, a shape, or empty; end) of what begins at a position."""
    m = _FORM.match(text, at)
    if not m:
        return "", at
    return ("id", "phone")[m.lastindex - 1] if m.lastindex < 3 else shape(m.group()), m.end()


def senders(emails: DataFrame) -> DataFrame:
    """(word, role, n): given names and surnames of the header fields, lower case without accents.

    A display name counts where the user part of its address repeats it (``g.surname`` or ``given.surname``); user
    parts of that form in any address field give surnames of their own.
    """
    both = F.concat_ws(" ", "sender", "recipients", "cc", "bcc")
    users = emails.select(F.explode(F.regexp_extract_all(F.lower(both), F.lit(r"([a-z]+[._][a-z]{3,}(?:-[a-z]+)?)(?:\+[a-z0-9]+)?@"), 1)).alias("u"))
    parts = users.groupBy("u").agg(F.count("*").alias("n")).select(F.split("u", "[._]").alias("p"), "n")
    # both ends of a user part from one reading of the fields
    ends = F.array(*(F.struct(w.alias("word"), F.lit(role).alias("role")) for w, role in ((F.element_at("p", -1), "surname"), (F.col("p")[0], "given"))))
    users = parts.select(F.inline(ends), "n").where("role = 'surname' or length(word) > 2")
    plain = F.translate(F.regexp_replace(F.lower("sender"), r"\S+@\S+", " "), "àáâäãèéêëìíîïòóôöõùúûüñç", "aaaaaeeeeiiiiooooouuuunc")
    user = F.regexp_extract(F.lower("sender"), r"(?:^|[^a-z0-9])([a-z][._][a-z]{3,})[^@\s]*@", 1)
    named = emails.select(F.regexp_extract_all(plain, F.lit(r"([a-z']{2,})"), 1).alias("w"), F.substring(user, 1, 1).alias("i"), F.substring(user, 3, 1 << 30).alias("s"))
    # "Given Surname <g.surname@...>": the other word begins with the initial
    pair = named.where("i <> '' and array_contains(w, s)").select("i", "s", F.explode(F.slice("w", 1, 3)).alias("word")).where("length(word) > 2 and word <> s and startswith(word, i)")
    return users.unionByName(pair.groupBy("word").agg(F.count("*").alias("n")).select("word", F.lit("given").alias("role"), "n")).groupBy("word", "role").agg(F.sum("n").alias("n"))


class Lexicon:
    """Learned words (without accents; ``variants`` are spellings with them) and patterns."""

    def __init__(self, given, surname, variants, patterns):
        self.given, self.surname = frozenset(given), frozenset(surname) - frozenset(given)
        self.names = self.given | self.surname
        self.variants = variants
        self.patterns = patterns  # (kind, pattern) -> score
        self.kinds: dict[str, str] = {}
        self.contexts: dict[str, str] = {}
        self.leads: dict[str, int] = {}
        self._finder = None

    def kind(self, word: str) -> str:
        """``given``, ``surname``, ``firm``, ``open`` or empty for a word as it stands in a text."""
        k = self.kinds.get(word)
        if k is None:
            w = fold(word).rstrip("'’")
            k = "firm" if w in FIRM else "open" if w in OPEN else "given" if w in self.given else "surname" if w in self.surname else ""
            if len(self.kinds) > 200_000:
                self.kinds.clear()
            self.kinds[word] = k
        return k

    def pattern(self, word: str) -> str:
        """The pattern of the word before a position."""
        p = self.contexts.get(word)
        if p is None:
            if len(self.contexts) > 200_000:
                self.contexts.clear()
            p = self.contexts[word] = pattern_of(word, self.names) if word else "|"
        return p

    def lead(self, word: str) -> int:
        """What makes an unknown capitalised word after this one a name: 1 a trusted pattern, 2 a title, 4 an initial; their sum."""
        n = self.leads.get(word)
        if n is None:
            if len(self.leads) > 200_000:
                self.leads.clear()
            n = (self.patterns.get(("name", self.pattern(word)), 0.0) >= 0.9) + 2 * bool(_TITLES.fullmatch(word)) + 4 * (len(word) == 2 and word[1] == "." and word[0].isupper())
            self.leads[word] = n
        return n

    @property
    def finder(self):
        """Finds surnames in lower-case text."""
        if self._finder is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in [*self.surname, *(v for v in self.variants if fold(v) in self.surname)]:
                if len(w) > 4:
                    a.add_word(w, len(w))
            if len(a):
                a.make_automaton()
            self._finder = a
        return self._finder


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for f, name in enumerate(FIELDS, 1):
            for i, t in zip(ids, b.column(f).to_pylist()):
                if t:
                    yield i, name, t


def edges(emails: DataFrame, names: frozenset) -> DataFrame:
    """(kind, pattern, instance, n): what stands after what, over all texts."""
    shared = emails.sparkSession.sparkContext.broadcast(names)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        pairs: Counter = Counter()
        codes: Counter = Counter()

        def flush():
            seen: Counter = Counter()
            for (word, instance), n in pairs.items():
                seen["name", pattern_of(word, known), fold(instance)] += n
                if not instance.isascii():
                    seen["variant", "", instance.lower()] += n
            for (word, code), n in codes.items():
                seen["code", pattern_of(word, known) if word else "|", code] += n
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], ["kind", "pattern", "instance", "n"])
            pairs.clear(), codes.clear()
            return out

        for _, _, t in _texts(batches):
            pairs.update(_PAIR.findall(t))
            for a in starts(t):
                code, _ = code_kind(t, a)
                if code:
                    codes[before(t, a), code] += 1
            if len(pairs) + len(codes) > 300_000:
                yield flush()
        yield flush()

    rows = emails.select("id", *FIELDS).mapInArrow(tally, "kind string, pattern string, instance string, n long")
    return rows.groupBy("kind", "pattern", "instance").agg(F.sum("n").alias("n"))


def score(graph: DataFrame, seeds: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and instances of one kind by ROUNDS turns over (pattern, instance, n).

    ``seeds`` are (instance, seed) with seed 1 or 0; they keep their score, other instances start at 0. Returns
    (pattern, score, n, kinds) and (instance, score, n).
    """
    graph = graph.join(seeds, "instance", "left").withColumn("value", F.coalesce("seed", F.lit(0.0)))
    for _ in range(ROUNDS):
        patterns = graph.groupBy("pattern").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("score"), F.sum("n").alias("n"), F.count_if(F.col("value") > CONFIDENT).alias("kinds"))
        trusted = patterns.select("pattern", F.when((F.col("n") >= OFTEN) & (F.col("kinds") >= least), F.col("score")).otherwise(0.0).alias("trust"))
        instances = graph.join(trusted, "pattern").groupBy("instance").agg((F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))
        graph, _ = cut(graph.drop("value").join(instances.select("instance", "score"), "instance").withColumn("value", F.coalesce("seed", "score")).drop("score"))
    return patterns, instances


@tidy
def learn(emails: DataFrame) -> Lexicon:
    """Seeds, graph and scores of a corpus, as the lexicon of the last pass."""
    spark = emails.sparkSession
    found = senders(emails).orderBy(F.col("n").desc(), "word", "role").limit(MOST).collect()
    given = {r["word"] for r in found if r["role"] == "given" and r["n"] > 1} - FIRM - OPEN
    surname = {r["word"] for r in found if r["role"] == "surname"} - FIRM - OPEN
    graph, _ = cut(edges(emails, frozenset(given | surname)))
    words = graph.where("kind = 'name' and pattern <> '|'").drop("kind")  # the start of a line tells nothing
    seeds = spark.createDataFrame([(w, 1.0) for w in sorted(given | surname)] + [(w, 0.0) for w in sorted(FIRM | OPEN)], "instance string, seed double")
    patterns, instances = score(words, seeds)
    fresh = instances.join(seeds, "instance", "left_anti").where((F.col("score") >= CONFIDENT) & (F.col("n") >= 2) & (F.length("instance") > 2))
    more = [r["instance"] for r in fresh.orderBy(F.col("n").desc(), "instance").limit(MOST).select("instance").collect()]
    out = {}
    for r in patterns.where((F.col("score") >= CONFIDENT) & (F.col("n") >= OFTEN) & (F.col("kinds") >= 3)).orderBy(F.col("n").desc(), "pattern").limit(MOST // 10).collect():
        out["name", r["pattern"]] = r["score"]
    codes = graph.where("kind = 'code'").drop("kind")
    for kind, other in (("phone", "id"), ("id", "phone")):
        patterns, instances = score(codes, spark.createDataFrame([(kind, 1.0), (other, 0.0)], "instance string, seed double"), 1)
        of = patterns.where((F.col("score") >= 0.5) & (F.col("n") >= OFTEN)).orderBy(F.col("n").desc(), "pattern").limit(MOST // 10)
        for r in of.collect():
            out[kind, r["pattern"]] = r["score"]
        for r in instances.where((F.col("score") >= 0.3) & (F.col("n") >= OFTEN)).orderBy(F.col("n").desc(), "instance").limit(MOST // 10).collect():
            out[kind + " shape", r["instance"]] = r["score"]
    given |= {w for w in more if w not in surname}
    accented = graph.where("kind = 'variant'").groupBy("instance").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "instance").limit(MOST)
    return Lexicon(given, surname, [r["instance"] for r in accented.collect() if fold(r["instance"]) in surname], out)


_BETWEEN = re.compile(rf"(?:{_GAP}(?:[{_UP}]\.{_GAP})?|,{_GAP}|\.)\Z")
_NEXT = re.compile(rf"(?:{_GAP}|[ \t]*-[ \t]*)?([^\W\d_]+)")
_LETTERS = re.compile(r"[^\W\d_]+\Z")
_TITLES = re.compile(rf"(?i:(?:l['’]|un['’]|all['’]|dell['’]|dall['’])?{TITLE})\.?:?")
_WRAPPED = re.compile(rf"([^\W\d_]+){_GAP}\Z")
_AFTER = re.compile(r" ([^\W\d_]+)")
_NOT_PHONE = frozenset("ddt iva n. nr. no. nº".split())


@lru_cache(maxsize=1)
def _keys():
    """Finds the signs of addresses of both kinds in lower-case text in one pass: (order, length, rule, around)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    both = re.compile("|".join(f"(?:{r.pattern})" for _, r in _AROUND))  # some words open addresses in two languages
    rules: dict[str, tuple] = {}
    for order, (keys, rule, around) in enumerate([(_AT, EMAIL, True), *((k, r, False) for k, r in _STREET), *((k, both, True) for k, _ in _AROUND)]):
        for k in keys:
            rules.setdefault(k.lower(), (order, len(k), rule, around))
    for k, value in rules.items():
        a.add_word(k, value)
    a.make_automaton()
    return a


def occurrences(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in one text, in order, without overlaps."""
    out: list[tuple[int, int, str]] = []
    busy = bytearray(len(text) + 1)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found: list[tuple[int, int, int]] = []
    signs = None

    def take(a: int, z: int, kind: str) -> None:
        if not busy.count(1, a, z):
            out.append((a, z, kind))
            busy[a:z] = b"\x01" * (z - a)

    for end, (order, size, rule, around) in _keys().iter(low):
        at = end + 1 - size
        if around:
            if order:
                if signs is None:
                    signs = [m.start() for m in _SIGN.finditer(text)]
                near = bisect_left(signs, at - 70)
                if near == len(signs) or signs[near] >= at + 90:
                    continue
            for m in rule.finditer(text, max(0, at - 70), at + 90):
                if m.start() <= at < m.end():
                    found.append((order, *m.span()))
        elif (not at or not text[at - 1].isalnum()) and (m := rule.match(text, at)):
            found.append((order, *m.span()))
    for order, a, z in sorted(found):
        take(a, z, "email" if order == 0 else "address")
    for a in starts(text):
        if busy[a]:
            continue
        form, z = code_kind(text, a)
        if form == "id":
            take(a, z, "id_number")
        elif form == "phone":
            if 7 <= sum(map(str.isdigit, text[a:z])) <= 15 and not (text[a].isdigit() and before(text, a).lower() in _NOT_PHONE):
                take(a, z, "phone")
        elif form:
            pattern = lex.pattern(before(text, a))
            value, kind = max((lex.patterns.get((k, pattern), 0.0) if lex.patterns.get((k + " shape", form), 0.0) >= 0.3 else 0.0, k) for k in ("phone", "id"))
            if value >= CONFIDENT and (kind == "id" or (not form.strip("9") and 9 <= len(form) <= 13)):
                take(a, z, "phone" if kind == "phone" else "id_number")
    names(text, low, lex, busy, take)
    return sorted(out)


def names(text: str, low: str, lex: Lexicon, busy: bytearray, take) -> None:
    """Mark names: known words that stand together, and unknown capitalised words in trusted places."""
    hits: list[tuple[int, int, str]] = []  # begin, end, kind
    kinds, leads = lex.kinds, lex.leads
    for m in WORD.finditer(text):
        word = m.group()
        k = kinds.get(word)
        if k is None:
            k = lex.kind(word)
        if k == "firm" or k == "open":
            continue
        a = m.start()
        c = text[a - 1] if a else "\n"
        if busy[a] or c.isalnum() or c in "@_":
            continue
        if not k:
            if c == "\n":
                continue
            prev = before(text, a)
            if not prev:
                continue
            n = leads.get(prev)
            if n is None:
                n = lex.lead(prev)
            if n and (n & 2 or n & 1 and word[1:].islower() and len(word) > 2 or n & 4 and len(word) > 3):
                k = "guess"
            elif hits and hits[-1][2] == "given" and text[hits[-1][1] : a] == " " and len(word) > 3:
                k = "guess"  # an unknown surname after a given name
            else:
                # an unknown surname before a given name: looked at when that is reached
                continue
        hits.append((a, m.end(), k))
    if len(lex.finder):
        extra = []
        for end, size in lex.finder.iter(low):
            a, z = end + 1 - size, end + 1
            if text[a].isupper() or busy[a] or (a and (low[a - 1].isalnum() or low[a - 1] in "@_'’")) or (z < len(low) and (low[z].isalnum() or low[z] in "@_")):
                continue
            g = _LETTERS.search(text, max(0, a - 20), a - 1) if a and text[a - 1] in " ." else None
            if g is None and a > 1 and text[a - 1] in "\n> |":  # wrapped between the names
                gap = _WRAPPED.search(text[max(0, a - 40) : a])
                if gap and lex.kind(gap.group(1)) == "given":
                    b = max(0, a - 40) + gap.start(1)
                    extra.append((b, z, "given"))
                continue
            if g and lex.kind(g.group()) == "given":
                extra.append((g.start(), z, "given"))
            else:  # "surname given"
                n = _AFTER.match(text, z)
                if n and lex.kind(n.group(1)) == "given" and not text[n.start(1)].isupper():
                    extra.append((a, n.end(), "given"))
        hits = sorted(hits + extra)
    i = 0
    while i < len(hits):
        j = i
        while j + 1 < len(hits) and j - i < 3 and (hits[j + 1][0] <= hits[j][1] or hits[j + 1][0] - hits[j][1] < 16 and _BETWEEN.match(text, hits[j][1], hits[j + 1][0]) and not (text[hits[j][1]] == "," and (hits[i][2] != "surname" or j > i))):
            j += 1
        a, z = hits[i][0], max(h[1] for h in hits[i : j + 1])
        kinds = [h[2] for h in hits[i : j + 1]]
        i = j + 1
        if "given" not in kinds:
            after = _NEXT.match(text, z)
            if after and lex.kind(after.group(1)) == "firm":
                continue
            prev = before(text, a)
            if prev and lex.kind(prev.rstrip(".,")) == "firm":
                continue
        lead = before(text, a)
        if len(lead) == 2 and lead[1] == "." and lead[0].isupper():
            a -= 2 if text[a - 1] == "." else len(text[:a]) - len(text[:a].rstrip(" \t")) + 2
        elif a > 1 and text[a - 1] == "." and text[a - 2].isupper() and (a < 3 or not text[a - 3].isalnum()):
            a -= 2  # "M.Rossi"
        elif kinds == ["given"] and lead[:1].isupper() and len(lead) > 3 and lead.isalpha() and not lex.kind(lead):
            b = a - 1
            while text[b - 1] in " \t":
                b -= 1
            b = text.rfind(lead, 0, b + 1)
            start = before(text, b)
            if not busy[b] and (start and start[-1] not in ".!?:;,-–•" and start.strip(">|") or lead.isupper() and len(lead) > 4):
                a = b  # an unknown surname before a given name
        take(a, z, "name")


@tidy
def find(emails: DataFrame) -> DataFrame:
    """(id, field, kind, start_pos, end_pos) of every occurrence in ``subject`` and ``body_plain``.

    Positions count characters from 0. Null and empty texts have none; equal texts come out alike.
    """
    lex = learn(emails)
    shared = emails.sparkSession.sparkContext.broadcast((sorted(lex.given), sorted(lex.surname), lex.variants, lex.patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(*shared.value)
        for b in batches:
            ids, fields, kinds, begins, ends = [], [], [], [], []
            for i, name, t in _texts([b]):
                for a, z, kind in occurrences(t, words):
                    ids.append(i), fields.append(name), kinds.append(kind), begins.append(a), ends.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(fields, pa.string()), pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["id", "field", "kind", "start_pos", "end_pos"])

    kind = emails.schema["id"].dataType.simpleString()
    return emails.select("id", *FIELDS).mapInArrow(run, f"id {kind}, field string, kind string, start_pos long, end_pos long")


@tidy
def redact(emails: DataFrame) -> DataFrame:
    """(id, subject, body_plain) with typed placeholders such as ``[EMAIL]`` and all else unchanged."""
    lex = learn(emails)
    shared = emails.sparkSession.sparkContext.broadcast((sorted(lex.given), sorted(lex.surname), lex.variants, lex.patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(*shared.value)
        for b in batches:
            columns = [b.column(0)]
            for f in (1, 2):
                texts = []
                for t in b.column(f).to_pylist():
                    for a, z, kind in reversed(occurrences(t, words) if t else []):
                        t = f"{t[:a]}[{kind.upper()}]{t[z:]}"
                    texts.append(t)
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", *FIELDS])

    kind = emails.schema["id"].dataType.simpleString()
    return emails.select("id", *FIELDS).mapInArrow(run, f"id {kind}, subject string, body_plain string")
