"""What the sender newly wrote in an e-mail (problem 7).

Threads are reconstructed from the reference headers. Every body becomes the sequence of its words, so that quoting
marks and wrapping do not matter, and every place in it a shingle: the words from there on (and back) until they have SPAN signs.
The sequence of a message's unmarked lines is aligned with that of each message it cites: where shingles agree, the
same words follow each other in both, and the shingles together cover each common run to its true ends. Lines covered
by them are inherited. They are added to what the marks in the text itself tell: quoting prefixes,
reply and forward headers with the lines that introduce them, then signatures and notices in what is left. Only
word codes and line numbers are shuffled, never bodies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carteggio.llm.threads import clean_id, header, ids_in
from carteggio.session import cut, tidy

#: Signs in a row that an inherited run needs, and from which on it is inherited whatever others write; share of a line's
#: signs in such runs. A shorter run that stands in replies to different messages is a common phrase and no quotation.
SPAN, SURE, SHARE = 60, 80, 0.8
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TOKEN = re.compile(r"\n|[^\W_]+")
#: Stands for a line end among the codes of words.
LINE_END = -(1 << 31)

PREFIX = re.compile(r"\s*(?:[A-Z]{1,3}>|[>|])")
# Words that introduce quotations, by language.
_VERB = r"(?:ha scritto|scrive|wrote|writes|a écrit|escribió|schrieb)"
INTRO = re.compile(
    rf"(?:il giorno|in data|on|le|el|am|il)\s.{{4,200}}\b{_VERB}(?:\s.{{0,80}})?\s*:"
    rf"|(?![-*•]\s).{{0,140}}\b{_VERB}(?:\s(?:on|am|le|el|il)?\s?\d.{{0,30}})?\s*:"
    r"|\d{1,4}[./-]\d{1,2}[./-]\d{2,4},?\s.{0,4}\d{1,2}[:.]\d{2}(?:[\s,;-].{0,100})?:"
    r"|(?:citando|quoting|citant|en citant|je cite|citation de|zitat von|zitiere|citado|cito|citazione da)\b.{2,90}:",
    re.I,
)
ENDS_INTRO = re.compile(rf"(?:{_VERB}.*|\d[:.]\d{{2}}.*|>\s*|^scritto\s*|^écrit\s*|(?i:citando|quoting|citant|zitat|citado|cito).*):\s*$")
RULE = re.compile(r"(?:-{3,}\s*\w.*\w\s*-{3,}|_{20,}|(?:inizio|begin|début|beginn|anfang|inicio)\b.{0,50}(?:inoltrat|forwarded|transf|transm|weiterg|reenvi).{0,20}:)$", re.I)
RULE_SIGNS = frozenset("-_ibdaIBDAİı")  # what RULE can begin with, case ignored
FROM = re.compile(r"\W{0,3}(?:da|from|von|de|mittente)\*?\s?:\*?\s*\S", re.I)
FIELD = re.compile(r"\W{0,3}(?:inviato|sent|gesendet|envoyé|enviado|data|date|datum|fecha|a|to|an|à|para|cc|oggetto|subject|betreff|objet|asunto)\*?\s?:\*?", re.I)
# Closing formulas, separators, device lines and openings of notices, by language.
CLOSING = re.compile(
    r"(?:(?:i (?:miei )?)?(?:(?:più )?(?:cordiali|distinti|migliori)\s)?saluti|cordialmente|cordialità|un (?:cordiale |caro )?saluto|saluti cordiali|grazie(?: (?:e|mille|per).{0,30})?|a presto|"
    r"cs|buona giornata|buon lavoro|in fede|(?:best|kind|warm|many)?\s?regards|best|best wishes|cheers|yours (?:sincerely|faithfully|truly)|sincerely|(?:many )?thanks(?: and (?:best|regards))?|"
    r"(?:bien )?cordialement|bien à vous|(?:meilleures )?salutations(?: distinguées)?|amicalement|merci|mit (?:freundlichen|besten) grü(?:ß|ss)en|(?:beste|viele|freundliche|herzliche|liebe) grü(?:ß|ss)e|mfg|lg|vg|"
    r"atentamente|(?:un )?saludos?(?: cordial(?:es)?)?|cordiales saludos|gracias)\s*[,.!]?",
    re.I,
)
SEPARATOR = re.compile(r"(?:--+|_{3,}|(?:\*\s?){3,}|={3,}|—+|~{3,})\s*")
DEVICE = re.compile(r"(?:inviato d|sent from|sent via|von unterwegs|gesendet (?:mit|von)|von meinem .{2,30} gesendet|envoyé d|enviado d|mandato dal|get outlook).{0,70}", re.I)
NOTICE = re.compile(
    r"[*\W]{0,3}(?:(?:nota|avviso|clausola) di riservatezza|riservatezza\b|avviso legale|trattamento dei dati|ai sensi (?:del|dell|della|degli|dei)\b.{0,60}(?:dati|privacy|gdpr|regolamento)|informativa\b.{0,30}privacy|"
    r"il presente (?:scritto|messaggio)\b|(?:questo|questa) (?:messaggio|e-?mail|comunicazione)\b.{0,60}(?:allegat|riservat|destinat|confiden|riguarda)|le informazioni (?:riportate|contenute)\b|se non siete (?:la persona|il destinat)|"
    r"chi lo ha ricevuto per|prima di stampare|pensa (?:all.ambiente|prima di stamp)|rispetta l.ambiente|"
    r"confidential(?:ity)?\b.{0,20}(?:note|notice|:)|the contents? of this (?:message|e-?mail)|this (?:message|e-?mail|communication)\b.{0,60}(?:attach|confiden|intended|meant|privileged)|legal notice|disclaimer|"
    r"not the person this was|if (?:it|you|this)\b.{0,30}(?:by mistake|in error|not the intended)|no contract is formed|save paper|(?:please )?(?:think|consider)\b.{0,40}(?:print|environment)|before (?:you )?print|"
    r"ce (?:message|courriel)\b.{0,60}(?:réserv|confiden|destin)|avertissement\b|avis de confidentialité|avant d.imprimer|pensez à l.environnement|"
    r"diese (?:nachricht|e-?mail)\b.{0,40}(?:vertraulich|bestimmt|enthält)|vertraulichkeit|falls sie\b.{0,20}irrtümlich|rechtlicher hinweis|bitte denken sie an die umwelt|"
    r"este (?:mensaje|correo)\b.{0,40}(?:confiden|destin|dirige)|aviso (?:legal|de confidencialidad)|si lo recibió por error|antes de imprimir|piense en el medio)",
    re.I,
)
GREETING = re.compile(r"(?:car[oaie]|ciao|gentil[ei]|egregi[oa]?|salve|buon(?:giorno|asera)|spett|hall?o|hi|liebe[rs]?|dear|hello|good|guten|sehr|cher|chère|madame|monsieur|bonjour|hola|estimad|querid|buen[oa]s|señor)\b", re.I)
CONTACT = re.compile(r"(?:tel(?:/fax)?|cell|t|m|fax|ph|phone|mob(?:ile|il)?|tfno|móvil|tél)\b\.?\s*:?\s*[+(]?\d.*|[+(]?\d[\d\s().+/-]{5,}|(?:e-?mail|mail|posta)\b\.?\s*:?\s*\S+@\S*[^\s.]|\S+@\S*[^\s.]|(?:https?://|www\.)\S+", re.I)
STREET = re.compile(r"\d.*\b(?:st|str|rd|ave|ln|blvd|sq|pl)\.$", re.I)
STOPS = (".", "?", "!", ";", ":", ",")


def _sign_like(s: str) -> int:
    """3 closing formula, separator or device line, 2 like a name, 1 contact or other short line, 0 text."""
    if SEPARATOR.fullmatch(s) or CLOSING.fullmatch(s) or DEVICE.fullmatch(s):
        return 3
    if len(s) > 70 or s[0] in "-*•" or GREETING.match(s):
        return 0
    if s.endswith(STOPS) and not STREET.search(s):
        return 0
    if CONTACT.fullmatch(s):
        return 1
    if any(c.isdigit() for c in s):
        return 1
    if not s[0].isupper():
        return 0
    words = s.split()
    if len(words) > 5:
        return 0
    return 2 if all(w[0].isupper() for w in words) and len(words) <= 4 else 1


def classify(body: str) -> list[str]:
    """Kind of every line: ``quoted``, ``signature``, ``disclaimer``, or empty for new and blank lines."""
    lines = [x.strip() for x in body.split("\n")]
    n = len(lines)
    kind = [""] * n
    # prefixed lines
    runs, i = [], 0
    prefixed = [">" in s[:4] or s[:1] == "|" for s in lines]  # what no other line has; most need no expression then
    while i < n:
        if prefixed[i] and PREFIX.match(lines[i]):
            j = i
            while j < n and prefixed[j] and PREFIX.match(lines[j]):
                j += 1
            if j - i > 1 or not re.match(r"[>|]\s*\d", lines[i]):
                runs.append((i, j))
            i = j
        else:
            i += 1
    for a, z in runs:
        kind[a:z] = ["quoted"] * (z - a)
    # reply and forward headers: all that follows is quoted
    end = n
    for i in range(n):
        if kind[i] or not lines[i]:
            continue
        s = lines[i]
        start = -1
        if ":" in s[:16] and FROM.match(s) and not SEPARATOR.fullmatch(s):
            near = [k for k in range(i + 1, min(n, i + 4)) if FIELD.match(lines[k])]
            above = next((k for k in range(i - 1, max(-1, i - 4), -1) if lines[k]), -1)
            ruled = above >= 0 and RULE.match(lines[above])
            if near or (ruled and "@" in s) or ruled:
                start = above if ruled else i
        elif s[0] in RULE_SIGNS and RULE.match(s) and not SEPARATOR.fullmatch(s):
            start = i
        if start >= 0:
            end = start
            for k in range(start, n):
                if lines[k]:
                    kind[k] = "quoted"
            break
    # lines that introduce a quotation, or stand at the very end where it was cut off
    last = end - 1
    while last >= 0 and not lines[last]:
        last -= 1
    marks = [a for a, _ in runs if a < end]
    if last >= 0 and not kind[last]:
        marks.append(last + 1)
    for a in marks:
        z = a - 1
        while z >= 0 and not lines[z] and a - z <= 3:
            z -= 1
        if z < 0 or kind[z] or not lines[z] or not lines[z].endswith(":") or not ENDS_INTRO.search(lines[z]):
            continue
        top = z
        while top > 0 and z - top < 4 and lines[top - 1] and not kind[top - 1]:
            top -= 1
        for k in range(top, z + 1):
            joined = " ".join(lines[k : z + 1])
            if len(joined) <= 260 and INTRO.fullmatch(joined) and (k == z or not lines[k].endswith((".", ",", "?", "!")) or lines[k][:3].lower() in ("on ", "le ", "el ", "am ", "il ", "in ")):
                for x in range(k, z + 1):
                    kind[x] = "quoted"
                break
    # what is left, segment by segment
    i, segments = 0, []
    while i < n:
        if kind[i] == "quoted":
            i += 1
            continue
        j = i
        while j < n and kind[j] != "quoted":
            j += 1
        if any(lines[i:j]):
            segments.append((i, j))
        i = j
    for number, (a, z) in enumerate(segments):
        k = a
        while k < z:  # notices: from their opening to the end of the paragraph
            if lines[k] and NOTICE.match(lines[k]) and (k == a or not lines[k - 1] or kind[k - 1] or _sign_like(lines[k - 1])):
                while k < z and lines[k]:
                    kind[k] = "disclaimer"
                    k += 1
            else:
                k += 1
        tail, k, ranks = [], z - 1, []
        while k >= a:
            s = lines[k]
            if s and not kind[k]:
                r = _sign_like(s)
                if not r:
                    break
                tail.append(k)
                ranks.append(r)
            k -= 1
        if not tail:
            continue
        strong = [k for k, r in zip(tail, ranks) if r == 3]
        if strong:
            first = strong[-1]
            # a device line alone does not mark the name above it
            if all(DEVICE.fullmatch(lines[k]) for k in strong):
                named = [k for k, r in zip(tail, ranks) if r == 2]
                first = min([first, *named])
        elif number == len(segments) - 1 and 2 in ranks:
            first = min(k for k, r in zip(tail, ranks) if r == 2)
        else:
            continue
        for k in tail:
            if k >= first:
                kind[k] = "signature"
    return kind


def code(word: str) -> int:
    """27 bits of hash and 5 of length; 0 stands for no word, LINE_END for a line end."""
    if word == "\n":
        return LINE_END
    return (zlib.crc32(word.encode("utf-8", "replace")) >> 5 << 5 | min(len(word), 31)) - (1 << 31)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = known = code(word)
        return known


_CODES = _Codes()


def codes_of(words: list[str]) -> np.ndarray:
    """Codes of words; those of some 200,000 words are kept."""
    if len(_CODES) > 200_000:
        _CODES.clear()
    return np.fromiter(map(_CODES.__getitem__, words), np.int32, len(words))


def shingles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the shingles of a sequence; 0 in it is a break that no shingle crosses."""
    signs = np.where(codes == 0, 0, codes.astype(np.int64) & 31)
    total = np.concatenate(([0], np.cumsum(signs)))
    end = np.searchsorted(total, total[:-1] + SPAN)
    breaks = np.concatenate(([0], np.cumsum(codes == 0)))
    begin = np.flatnonzero(end <= len(codes))
    begin = begin[breaks[end[begin]] == breaks[begin]]
    end = end[begin]
    if not len(begin):
        return begin, end, np.zeros(0, dtype=np.uint64)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes) - 1, BASE))))
    back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes) - 1, INVERSE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((codes.astype(np.int64).view(np.uint64) * INVERSE + np.uint64(1)) * power)))
    return begin, end, (sums[end] - sums[begin]) * back[begin]


def with_lines(codes: np.ndarray, line: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words with a mark before the first word of every line: its number in place of the hash, its length 0.

    ``row`` tells lines of different messages apart. Also returns the places of the first words of lines.
    """
    at = np.flatnonzero(np.concatenate(([True], np.diff(row) != 0))) if len(row) else np.zeros(0, dtype=np.int64)
    return np.insert(codes, at, (line[at].astype(np.int64) * 32 + LINE_END).astype(np.int32)), at


def inherited(fresh: list[np.ndarray], old: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, line, run) of the lines of each ``fresh`` whose words stand in runs that its ``old`` has in the same order.

    ``fresh`` are results of :func:`with_lines`, ``old`` codes of words. ``run`` is 0 if the run has SURE signs, else a hash
    that names it. All pairs are aligned at once: a shingle stands for its hash and its pair.
    """
    a, o = (np.concatenate([np.append(x, np.int32(0)) for x in xs]).astype(np.int64) for xs in (fresh, old))
    pair, pair_o = (np.repeat(np.arange(len(xs)), [len(x) + 1 for x in xs]) for xs in (fresh, old))
    mark = ((a & 31) == 0) & (a != 0)
    line = np.maximum.accumulate(np.where(mark, pair * (1 << 32) + ((a - LINE_END) >> 5), 0))  # a pair begins with a mark or is a lone 0
    a, pair, line = a[~mark].astype(np.int32), pair[~mark], line[~mark]
    o = o.astype(np.int32)
    key = lambda p, h: h ^ (p.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    begin, end, h = shingles(a)
    other, _, g = shingles(o)
    hit = np.isin(key(pair[begin], h), key(pair_o[other], g)) if len(h) else np.zeros(0, dtype=bool)
    none = np.zeros(0, dtype=np.int64)
    if not hit.any():
        return none, none, none
    step = np.zeros(len(a) + 1, dtype=np.int64)
    np.add.at(step, begin[hit], 1)
    np.add.at(step, end[hit], -1)
    name = np.full(len(a), np.iinfo(np.int64).max)
    name[begin[hit]] = (h[hit] >> np.uint64(2)).astype(np.int64) + 1
    # forward shingles reach the first word of a run, backward ones its last
    begin, end, h = shingles(a[::-1])
    other, _, g = shingles(o[::-1])
    hit = np.isin(key(pair[::-1][begin], h), key(pair_o[::-1][other], g))
    np.add.at(step, len(a) - end[hit], 1)
    np.add.at(step, len(a) - begin[hit], -1)
    signs = np.where(a == 0, 0, a.astype(np.int64) & 31)
    inside = np.cumsum(step)[:-1] > 0
    run = np.cumsum(inside & ~np.concatenate(([False], inside[:-1])))
    length = np.bincount(run, np.where(inside, signs, 0))
    names = np.full(len(length), np.iinfo(np.int64).max)
    np.minimum.at(names, run, np.where(inside, name, np.iinfo(np.int64).max))
    word = a != 0
    touched = np.unique(line[inside])
    some = np.flatnonzero(word & np.isin(line, touched))
    numbers, at = np.unique(line[some], return_inverse=True)
    every, covered = np.bincount(at, signs[some]), np.bincount(at, signs[some] * inside[some])
    best = np.zeros(len(numbers), dtype=np.int64)  # the longest run of each line
    order = np.flatnonzero(inside[some])
    order = order[np.argsort(length[run[some[order]]], kind="stable")]
    best[at[order]] = run[some[order]]
    good = (covered > 0) & (covered >= SHARE * every)
    return numbers[good] >> 32, numbers[good] & ((1 << 32) - 1), np.where(length[best[good]] >= SURE, 0, names[best[good]])


def words_lines(codes: np.ndarray) -> np.ndarray:
    """Numbers of the lines of a result of :func:`with_lines`."""
    x = codes.astype(np.int64)
    return (x[((x & 31) == 0) & (x != 0)] - LINE_END) >> 5


def ancestors(messages: DataFrame) -> DataFrame:
    """(parent, own): what a message cites, and what is cited further up where each message cites only its parent.

    ``messages`` is (own, cited). Messages with a list of references know their thread; the others, which cite one
    message, take over its ancestors, and those of the ancestor farthest up, until nothing is added: the known chains
    double in length each time. A message that would be its own ancestor is left out.
    """
    known = messages.where("size(cited) > 0").groupBy("own").agg(F.max_by("cited", F.struct(F.size("cited"), "cited")).alias("cited"))
    known, _ = cut(known.select(F.col("own").alias("parent"), "cited"))
    while True:
        top = known.select(F.col("parent").alias("_top"), F.col("cited").alias("_more"))
        grown = known.join(top, F.get("cited", F.lit(0)) == F.col("_top"), "left")  # references begin with the eldest
        more = F.filter(F.coalesce("_more", F.array().cast("array<string>")), lambda x: (x != F.col("parent")) & ~F.array_contains("cited", x))
        # another name than ``cited``, which the lambdas would take for the new column
        grown, _ = cut(grown.select("parent", F.concat(more, "cited").alias("all"), (F.size(more) > 0).alias("grew")).withColumnRenamed("all", "cited"))
        if not grown.where("grew").limit(1).count():
            return grown.select("parent", F.explode("cited").alias("own"))
        known = grown.drop("grew")


@tidy
def lines(emails: DataFrame) -> DataFrame:
    """(id, line_no, kind) of every line that is neither blank nor newly written.

    ``kind`` is ``quoted``, ``signature`` or ``disclaimer``; lines count from 1 and end at line feeds. Null and blank
    bodies give no rows, repeated rows (same id) give theirs once, messages without usable headers are judged by their
    own marks alone.
    """
    headers = F.from_json("raw_headers_json", "map<string,string>")
    rows = emails.where(F.col("body_plain").rlike(r"\S")).select("id", "body_plain", "original_message_id", headers.alias("h"))
    own = F.coalesce(clean_id(F.col("original_message_id")), F.get(ids_in(header(F.col("h"), "message-id")), F.lit(0)))
    cited = F.array_distinct(F.concat(ids_in(header(F.col("h"), "references")), ids_in(header(F.col("h"), "in-reply-to"))))
    rows = rows.select("id", own.alias("own"), cited.alias("cited"), "body_plain")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark_type = pa.list_(pa.struct([("line", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                own, cited, bodies = (part.column(i).to_pylist() for i in (1, 2, 3))
                n, kinds = len(bodies), [classify(x) for x in bodies]
                # a message that neither cites nor can be cited has nothing to align
                tokens = [TOKEN.findall(x.lower()) if o or c else [] for o, c, x in zip(own, cited, bodies)]
                size = np.array([len(x) for x in tokens])
                codes, of = codes_of(list(chain.from_iterable(tokens))), np.repeat(np.arange(n), size)
                ends = codes == LINE_END
                passed = np.concatenate(([0], np.cumsum(ends)))
                # lines of all messages in one sequence
                height = np.array([len(x) for x in kinds])
                top = np.cumsum(height) - height
                marked = np.fromiter(map(bool, chain.from_iterable(kinds)), bool, int(height.sum()))
                line = (passed[:-1] - np.repeat(passed[np.cumsum(size) - size], size))[~ends]
                whole, of = codes[~ends], of[~ends]
                signs = lambda x, of: np.bincount(of, x & 31, n)
                row = top[of] + line
                cites = np.array([bool(c) for c in cited])
                empty = np.flatnonzero((np.bincount(row, minlength=len(marked)) == 0) & ~marked & np.repeat(cites, height))
                bare = [[] for _ in range(n)]
                for i, k in zip((np.searchsorted(top, empty, "right") - 1).tolist(), empty.tolist()):
                    bare[i].append(k - int(top[i]) + 1)
                for i in np.flatnonzero(cites).tolist():
                    if bare[i]:
                        text = bodies[i].split("\n")
                        bare[i] = [k for k in bare[i] if text[k - 1].strip()]
                # words before and after marked lines do not follow each other: one 0 stands for all of them
                hidden = marked[row]
                begins = np.concatenate(([True], np.diff(of) != 0)) if len(of) else np.zeros(0, dtype=bool)
                keep = (~hidden | begins | ~np.concatenate(([False], hidden[:-1]))[: len(hidden)]) & cites[of]
                fresh, of_fresh, row = np.where(hidden, np.int32(0), whole)[keep], of[keep], row[keep]
                some = (signs(fresh, of_fresh) >= SPAN)[of_fresh]  # else too little for a run
                fresh, of_fresh, row = fresh[some], of_fresh[some], row[some]
                fresh, first = with_lines(fresh, row - top[of_fresh] + 1, row)
                in_fresh = np.bincount(of_fresh, minlength=n) + np.bincount(of_fresh[first], minlength=n)
                some = (signs(whole, of) >= SPAN)[of]
                lists = lambda x, size: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(np.asarray(x, dtype=np.int32)))
                known = [[{"line": k, "kind": w} for k, w in enumerate(ks, 1) if w] for ks in kinds]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), lists(whole[some], np.bincount(of[some], minlength=n)), pa.array(known, mark_type), lists(fresh, in_fresh), lists(list(chain.from_iterable(bare)), [len(x) for x in bare])],
                    schema=pa.schema([part.schema.field(0), part.schema.field(1), part.schema.field(2), ("words", pa.list_(pa.int32())), ("known", mark_type), ("fresh", pa.list_(pa.int32())), ("bare", pa.list_(pa.int32()))]),
                )

    kind = "id long, own string, cited array<string>, words array<int>, known array<struct<line:long,kind:string>>, fresh array<int>, bare array<int>"
    base, _ = cut(rows.mapInArrow(read, kind))
    marked = base.select("id", F.explode("known").alias("k")).select("id", F.col("k.line").alias("line_no"), "k.kind")
    # words of the cited messages; several copies of a message have the same ones, so the smallest id will do
    above = ancestors(base.where("own is not null").select("own", "cited"))
    of = base.where("size(fresh) > 0").select("id", "fresh", "bare", "cited")
    cites = of.select("id", "fresh", "bare", F.explode("cited").alias("own")).where(F.col("own").isNotNull())
    further = of.where("size(cited) = 1").select("id", "fresh", "bare", F.col("cited")[0].alias("parent")).join(above, "parent").select("id", "fresh", "bare", "own")
    cites = cites.unionByName(further)
    first = base.where("own is not null and size(words) > 0").groupBy("own").agg(F.min("id").alias("id"))
    owners = base.where("size(words) > 0").select("id", "own", "words").join(first, ["id", "own"], "left_semi").dropDuplicates(["own"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                part = b.slice(begin, 500)
                fresh, bare, old = ([x.values.to_numpy() for x in part.column(c)] for c in (1, 2, 3))
                pair, line, run = inherited(fresh, old)
                more = [[], [], []]
                for i in np.unique(pair[[len(bare[p]) > 0 for p in pair]] if len(pair) else pair).tolist():
                    # lines without words belong to the run on both sides of them
                    has, named = np.unique(words_lines(fresh[i])), dict(zip(line[pair == i].tolist(), run[pair == i].tolist()))
                    for k in bare[i].tolist():
                        j = int(np.searchsorted(has, k))
                        if 0 < j < len(has) and has[j - 1] in named and has[j] in named:
                            for column, v in zip(more, (i, k, named[int(has[j - 1])])):
                                column.append(v)
                pair, line, run = (np.concatenate((x, np.array(y, dtype=np.int64))) for x, y in zip((pair, line, run), more))
                place = pa.array(pair)
                yield pa.RecordBatch.from_arrays([part.column(0).take(place), pa.array(line), pa.array(run), part.column(4).take(place)], ["id", "line_no", "run", "own"])

    within = cites.join(owners.select("own", "words"), "own").select("id", "fresh", "bare", "words", "own").mapInArrow(align, "id long, line_no long, run long, own string")
    within, _ = cut(within)
    phrases = within.where("run <> 0").groupBy("run").agg(F.min("own").alias("a"), F.max("own").alias("z")).where("a <> z").select("run")
    within = within.join(phrases, "run", "left_anti")
    return marked.unionByName(within.select("id", "line_no", F.lit("quoted").alias("kind"))).dropDuplicates(["id", "line_no"])


def split(emails: DataFrame, found: DataFrame) -> DataFrame:
    """(id, current_text, quoted_thread_text, signature_text, disclaimer_text) from the lines of :func:`lines`."""
    kinds = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "kind"))).alias("kinds"))
    rows = emails.where("body_plain is not null").select("id", F.split("body_plain", "\n").alias("lines")).dropDuplicates(["id"]).join(kinds, "id", "left")
    of = lambda w: F.trim(F.array_join(F.filter("lines", lambda x, i: F.coalesce(F.col("kinds")[(i + 1).cast("long")], F.lit("")) == w), "\n"))
    return rows.select("id", of("").alias("current_text"), of("quoted").alias("quoted_thread_text"), of("signature").alias("signature_text"), of("disclaimer").alias("disclaimer_text"))
