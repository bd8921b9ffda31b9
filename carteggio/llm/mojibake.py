"""Restore texts that were read under a wrong character encoding (problem 10).

Every distinct text is counted and judged once, so a text does not become normal by its copies; the results are joined
back to all rows by the hash of the text. First pass: in how many distinct texts does each pair of adjacent characters
occur, for pairs with a character beyond ASCII. Only lines that look like writing are counted: a line whose pairs
break the habits of scripts (a capital inside a word, a sign between letters, two scripts in a word) beyond ODD on
average is left out, so the counts describe sound text however many texts are garbled. They live in a count-min
sketch of fixed size, so what is broadcast does not grow with the corpus. Second pass, per document: every such pair
is scored by its share of the corpus's mutual information, ``p(ab) log(p(ab) / p(a)p(b))``; improbable pairs score
above zero, plain ASCII below, and the maximum-scoring segments of these scores are the suspicious runs. Only inside
those runs inverse mappings are tried: bytes of a wrong reading decoded as UTF-8 (repeatedly, for texts garbled
twice), then single-byte readings mistaken for each other. A mapping is kept if the result is more probable under the
corpus counts; how frequent the garbled pairs are among all texts does not matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carteggio.session import cut, tidy

#: Slots of each row of the pair sketch, rows of it, code points. An unseen pair seems to have been seen if it meets an
#: occupied slot in every row: with 300,000 different pairs about one in 400, with a million one in 20.
SLOTS, ROWS, CHARS = 1 << 21, 3, 0x110000
CHARS_MASK = (1 << 21) - 1
#: A pair with a smaller share of the mutual information is improbable; score of an ASCII character between runs.
SHARE, ASCII_SCORE = 0.3, -0.04
#: Mean oddity of a line's pairs from which on it is not counted.
ODD = 0.3
#: What a single-byte exchange must gain: nats in all and for each pair; share of its pairs that may be new to the corpus.
GAIN, EACH, NEW = 3.0, 1.0, 0.1
#: Readings tried, in order of preference on ties; the last list holds what single bytes may really have been.
READINGS = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "koi8_r", "cp1251", "cp1250")
SINGLE = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp850", "cp437", "iso8859_7", "cp1250")
LOST = re.compile(r"�|(?<=[^\W\d_])\?{2,}(?=[^\W\d_])|(?<=[^\W\d_])\?{2,}(?= [^\W\d_A-Z]| \d)|(?<= )\?{2,}(?= [^\W_])|(?<=[^\W\d_A-Z])\?(?=[^\W\d_A-Z]).*(?<=[^\W\d_A-Z])\?(?=[^\W\d_A-Z])|(?<!\?)\?{2,}(?=[^\W\d_])|\?{6,}", re.S)
SPANS = re.compile(r"([^\x00-\x7f]+)")
PAIRED = re.compile(r"[^\x00-\x7f]{2,}")


@lru_cache(maxsize=32)
def high(encoding: str) -> tuple[str, ...]:
    """What the bytes 128-255 stand for; bytes an encoding leaves open stand for the control of that number."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=32)
def sequences(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """Runs of UTF-8 sequences as they look under ``encoding``, and the bytes of its characters."""
    table = high(encoding)
    inverse = {}
    for b, c in enumerate(table, 128):
        inverse.setdefault(c, b)
    part = lambda lo, hi: "[" + "".join(re.escape(table[b - 128]) for b in range(lo, hi + 1)) + "]"
    tail = part(0x80, 0xBF)
    return re.compile(f"(?:{part(0xC2, 0xDF)}{tail}|{part(0xE0, 0xEF)}{tail}{{2}}|{part(0xF0, 0xF4)}{tail}{{3}})+"), inverse


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


# Kinds of characters: ASCII lower and upper letters, other Latin lower and upper, Greek, Cyrillic, letters without case,
# digits, blanks, punctuation, punctuation that stands apart, signs, lines and blocks, controls.
KINDS = "a A e E g G c C o d s p q m b x".split()


def _kind(n: int) -> int:
    c = chr(n)
    cat = unicodedata.category(c)
    if n < 128:
        k = "a" if c.islower() else "A" if c.isupper() else "d" if c.isdigit() else "s" if c.isspace() else "p" if c.isprintable() else "x"
    elif c.isspace() or n == 0xFEFF:
        k = "s"
    elif n in (0xAA, 0xBA) or cat in ("Pi", "Pf", "Pd", "Ps", "Pe") or c in "…‚„·¿¡":
        k = "p"
    elif cat[0] == "L":
        low = cat != "Lu"
        k = ("g" if low else "G") if 0x370 <= n < 0x400 else ("c" if low else "C") if 0x400 <= n < 0x530 else ("e" if low else "E") if n < 0x250 or 0x1E00 <= n < 0x1F00 else "o"
    elif cat[0] == "M" or cat == "Cf":
        k = "o"
    elif cat[0] == "N":
        k = "m" if n < 0x2000 else "d"
    else:
        k = "q" if cat == "Po" else "b" if 0x2500 <= n < 0x25A0 else "m" if cat[0] == "S" else "x" if cat[0] == "C" else "o"
    return KINDS.index(k)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point below 0x3000, and the oddity of each pair of kinds."""
    kinds = np.array([_kind(n) for n in range(0x3000)], dtype=np.uint8)
    odd = np.zeros((len(KINDS), len(KINDS)))
    script = {"a": "l", "A": "l", "e": "l", "E": "l", "g": "g", "G": "g", "c": "c", "C": "c"}
    for i, x in enumerate(KINDS):
        for j, y in enumerate(KINDS):
            v = 0.0
            if x in script and y in script:
                v = 3.0 if script[x] != script[y] else 2.0 if x.islower() and y.isupper() else 1.0 if x + y in ("ee", "eE", "Ee") else 0.0
            elif x in script and y in "mqb":
                v = {"m": 0.3, "q": 1.0, "b": 1.5}[y]
            elif x in "mqb" and y in script:
                v = 0.5 if y.isupper() and x == "m" else 2.0
            elif "x" in (x, y):
                v = 3.0
            elif x + y in ("mq", "qm", "mm", "qq", "bm", "mb", "bq", "qb"):
                v = 0.5
            odd[i, j] = v
    return kinds, odd


def oddity(a: np.ndarray) -> np.ndarray:
    """How far each pair of adjacent code points is from what scripts do; 0 is usual."""
    kinds, odd = _tables()
    k = np.where(a < 0x3000, kinds[np.minimum(a, 0x2FFF)], np.where((a >= 0x1F000) & (a < 0x20000), KINDS.index("m"), KINDS.index("o")))
    return odd[k[:-1], k[1:]]


def slots(key: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of pair keys (first << 21 | second), one array for each row of the sketch."""
    for r, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)):
        h = (key + np.uint64(r + 1)) * np.uint64(m)
        yield ((h ^ (h >> np.uint64(32))) * np.uint64(m) >> np.uint64(43)).astype(np.int64) + r * SLOTS


def keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)


def counts(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """Documents per pair slot and per character over the lines that look like writing, and the number of documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars, n = np.zeros(ROWS * SLOTS, dtype=np.int32), np.zeros(CHARS, dtype=np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            n += len(texts)
            for at in range(0, len(texts), 500):  # many texts at once, a line end after each
                part = texts[at : at + 500]
                a = points("\n".join(part) + "\n")
                doc = np.repeat(np.arange(len(part)), [len(t) + 1 for t in part])
                plain = np.zeros((len(part), 128), dtype=bool)
                low = a < 128
                plain[doc[low], a[low]] = True
                chars[:128] += plain.sum(axis=0)
                wide = np.flatnonzero((a[:-1] > 127) | (a[1:] > 127))
                if not len(wide):
                    continue
                line = np.cumsum(a == 10)[wide + (a[wide] == 10)]
                odd = oddity(a)[wide]
                first = np.concatenate(([True], np.diff(line) != 0))
                where = np.cumsum(first) - 1
                mean = np.bincount(where, odd) / np.bincount(where)
                wide = wide[mean[where] < ODD]
                own = np.where(a[wide] == 10, doc[np.minimum(wide + 1, len(doc) - 1)], doc[wide]).astype(np.int64)
                both = np.stack((own, keys(a[wide], a[wide + 1]).astype(np.int64)))
                both = both[:, np.lexsort((both[1], both[0]))]
                once = np.concatenate(([True], (np.diff(both, axis=1) != 0).any(axis=0))) if both.shape[1] else np.zeros(0, dtype=bool)
                for s in slots(both[1][once].astype(np.uint64)):
                    np.add.at(pairs, s, 1)
                sign = np.concatenate((a[wide], a[wide + 1])).astype(np.int64)
                owner = np.concatenate((own, own))[sign > 127]
                u = np.unique(owner * CHARS + sign[sign > 127])
                np.add.at(chars, u % CHARS, 1)
        at = np.concatenate((np.flatnonzero(pairs), np.flatnonzero(chars) + len(pairs), [len(pairs) + CHARS]))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate((pairs, chars, [n]))[at])], ["slot", "n"])

    rows = df.where(F.col(text) != "").select(text).mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # at most ROWS * SLOTS + CHARS + 1 rows
    every = np.zeros(ROWS * SLOTS + CHARS + 1, dtype=np.int64)
    every[got["slot"].to_numpy()] = got["n"].to_numpy()
    return every[: ROWS * SLOTS].astype(np.int32), every[ROWS * SLOTS : -1].astype(np.int32), int(every[-1])


@lru_cache(maxsize=128)
def exchange(wrong: str, right: str) -> dict[int, str]:
    return {ord(w): r for w, r in zip(high(wrong), high(right)) if w != r}


MAPPINGS = tuple((w, r) for w in READINGS[1:] for r in SINGLE if w != r)


@lru_cache(maxsize=20_000)
def images(n: int) -> tuple[int, ...]:
    """What a code point becomes under each of MAPPINGS: itself if ASCII, -1 if the wrong reading does not have it."""
    if n < 128:
        return (n,) * len(MAPPINGS)
    c = chr(n)
    return tuple(ord(exchange(w, r).get(n, c)) if c in _signs(w) else -1 for w, r in MAPPINGS)


@lru_cache(maxsize=32)
def _signs(encoding: str) -> frozenset:
    return frozenset(high(encoding))


@lru_cache(maxsize=32)
def ends(encoding: str) -> tuple[frozenset, frozenset]:
    """Characters that begin and that continue a UTF-8 sequence under ``encoding``."""
    table = high(encoding)
    return frozenset(table[0xC2 - 128 : 0xF5 - 128]), frozenset(table[:64])


class Corpus:
    """Pair statistics of the corpus; what is known of a pair is worked out once and kept in tables."""

    #: Pairs kept at most; then the tables start anew.
    KEPT = 1 << 16

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, n: int):
        self.pairs, self.chars, self.n = pairs, chars, max(1, n)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[int, int] = {}
        self.scores = np.zeros(0)
        self.gains, self.has, self.fresh, self.moved = (np.zeros((0, len(MAPPINGS)), dtype=t) for t in (np.float32, bool, bool, bool))
        self.most, self.lead = np.zeros(0, dtype=np.float32), np.zeros(0, dtype=bool)

    def documents(self, key: np.ndarray) -> np.ndarray:
        """In how many documents each pair occurs: the least of its slots."""
        first, second, third = slots(key)
        return np.minimum(np.minimum(self.pairs[first], self.pairs[second]), self.pairs[third])

    def collisions(self) -> float:
        """Share of unseen pairs that seem to have been seen."""
        return float(np.prod([(self.pairs[r * SLOTS : (r + 1) * SLOTS] > 0).mean() for r in range(ROWS)]))

    def rows(self, key: np.ndarray) -> np.ndarray:
        """Places of different pairs in the tables."""
        if len(self.at) > self.KEPT:
            self._forget()
        fresh = [k for k in key.tolist() if k not in self.at]
        if fresh:
            self._learn(np.array(fresh, dtype=np.uint64))
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
        return np.array([self.at[k] for k in key.tolist()], dtype=np.int64)

    def _learn(self, key: np.ndarray) -> None:
        x, y = (key >> np.uint64(21)).astype(np.int64), (key & np.uint64(CHARS_MASK)).astype(np.int64)
        n = self.documents(key)
        ab = n / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(ab > 0, ab * np.maximum(np.log(ab / (self.chars[x] / self.n * (self.chars[y] / self.n) + 1e-12)), 0.05), 0)
        u, v = (np.array([images(c) for c in z.tolist()], dtype=np.int64) for z in (x, y))
        has = (u >= 0) & (v >= 0)
        there = self.documents(keys(np.maximum(u, 0), np.maximum(v, 0)).ravel()).reshape(u.shape)
        gain = np.where(has, np.log(there + 0.3) - np.log(n + 0.3)[:, None], 0).astype(np.float32)
        self.scores = np.concatenate((self.scores, np.clip(np.log(SHARE) - np.log(share + 1e-6), -1.5, 3.0)))
        self.gains, self.has, self.fresh = np.vstack((self.gains, gain)), np.vstack((self.has, has)), np.vstack((self.fresh, there < 2))
        self.moved = np.vstack((self.moved, (u != x[:, None]) | (v != y[:, None])))
        self.most = np.concatenate((self.most, np.where(has, gain, -np.inf).max(axis=1)))
        lead = [any(chr(p) in first and chr(q) in then for first, then in map(ends, READINGS)) for p, q in zip(x.tolist(), y.tolist())]
        self.lead = np.concatenate((self.lead, np.array(lead, dtype=bool)))

    def places(self, a: np.ndarray) -> np.ndarray:
        """Place in the tables of each pair of adjacent code points, -1 for pairs of ASCII."""
        out = np.full(len(a) - 1, -1, dtype=np.int64)
        wide = np.flatnonzero((a[:-1] > 127) | (a[1:] > 127))
        key, back = np.unique(keys(a[wide], a[wide + 1]), return_inverse=True)
        out[wide] = self.rows(key)[back]
        return out

    def fluency(self, text: str) -> tuple[float, int, float]:
        """Sum over the pairs beyond ASCII of the log of their documents, their number, and the smallest."""
        a = points(text)
        wide = np.flatnonzero((a[:-1] > 127) | (a[1:] > 127))
        if not len(wide):
            return 0.0, 0, 9.0
        logs = np.log(self.documents(keys(a[wide], a[wide + 1])) + 0.3)
        return float(logs.sum()), len(wide), float(logs.min())

    def runs(self, a: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs, grown to whole runs beyond ASCII.

        ``a`` are the code points of a text with a blank on both sides, ``at`` the places of their pairs.
        """
        turn = np.flatnonzero(np.diff((a > 127).view(np.int8)))
        if not len(turn):
            return []
        begins, ends_ = turn[::2], turn[1::2]
        total = np.concatenate(([0.0], np.cumsum(np.where(at < 0, ASCII_SCORE, self.scores[at]))))
        gains = (total[ends_ + 1] - total[begins]).tolist()
        # candidates as in Ruzzo and Tompa: (begin, end, score before, score after), merged from the right
        found: list[list[float]] = []
        level, end = 0.0, 0
        for b, z, gain in zip(begins.tolist(), ends_.tolist(), gains):
            level += (b - end) * ASCII_SCORE
            end, now = z, level + gain
            if gain > 0:
                item = [b, z, level, now]
                while True:
                    j = len(found) - 1
                    while j >= 0 and found[j][2] >= item[2]:
                        j -= 1
                    if j < 0 or found[j][3] >= item[3]:
                        found.append(item)
                        break
                    item = [found[j][0], item[1], found[j][2], item[3]]
                    del found[j:]
            level = now
        return [(int(f[0]), int(f[1])) for f in found]


@lru_cache(maxsize=200_000)
def span_as_utf8(span: str, reading: str) -> tuple[str, int]:
    """:func:`as_utf8` of signs beyond ASCII that stand together; the same ones recur all over a corpus."""
    pattern, inverse = sequences(reading)
    used = 0

    def decode(m: re.Match) -> str:
        nonlocal used
        try:
            plain = bytes(inverse[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        used += m.end() - m.start()
        return plain

    return pattern.sub(decode, span), used


def as_utf8(text: str, reading: str) -> tuple[str, int]:
    """``text`` with its UTF-8 sequences under ``reading`` decoded, and the number of characters they had."""
    parts, used = SPANS.split(text), 0
    for i in range(1, len(parts), 2):
        if len(parts[i]) > 1:
            parts[i], n = (span_as_utf8 if len(parts[i]) < 100 else span_as_utf8.__wrapped__)(parts[i], reading)
            used += n
    return "".join(parts), used


def restore_run(run: str, corpus: Corpus, left: str = " ", right: str = " ") -> tuple[str, str]:
    """The most probable original of a run between its neighbours, and the mappings that led to it.

    The run itself comes back if no mapping helps.
    """
    def value(s: str) -> float:
        total, n, _ = corpus.fluency(left + s + right)
        return total / n if n else 9.0

    best, now, seen = None, [(run, "")], {run}
    for _ in range(4):  # texts garbled twice may gain nothing until the second step
        further = []
        for s, path in now:
            signs = set("".join(PAIRED.findall(s)))  # a sequence has two signs at least
            for reading in READINGS:
                if any(e.isdisjoint(signs) for e in ends(reading)):
                    continue
                plain, used = as_utf8(s, reading)
                if used and plain not in seen:
                    seen.add(plain)
                    further.append((plain, f"{path} utf-8>{reading}".strip()))
                    best = max(best or (value(run), run, ""), (value(plain), *further[-1]), key=lambda x: x[0])
        now = further
    return best[1:] if best else (run, "")


def restore_single(text: str, at: np.ndarray, runs: list[tuple[int, int]], corpus: Corpus) -> tuple[str, str]:
    """Single-byte readings mistaken for each other, inside the suspicious runs.

    All mappings are scored at once from the pairs in and next to the runs (``at`` are the places of all pairs); the best
    one that gains GAIN in all and EACH for every pair, with almost no pair new to the corpus, is applied to the runs
    whose characters it has.
    """
    inside = [at[b : z + 1] for b, z in runs]
    inside = [p[p >= 0] for p in inside]
    if not any(corpus.most[p].sum() > EACH * len(p) for p in inside):  # no mapping can gain enough
        return text, ""
    run, at = np.repeat(np.arange(len(runs)), [len(p) for p in inside]), np.concatenate(inside)
    has = np.logical_and.reduceat(corpus.has[at], np.flatnonzero(np.concatenate(([True], np.diff(run) != 0))))
    use = has[run]
    gain, n, fresh = (np.where(use, t, 0).sum(axis=0) for t in (corpus.gains[at], np.float32(1), corpus.fresh[at]))
    good = (use & corpus.moved[at]).any(axis=0) & (gain > np.maximum(GAIN, EACH * n)) & (fresh <= NEW * n)
    if not good.any():
        return text, ""
    best = int(np.argmax(np.where(good, gain, -np.inf)))
    out, last = [], 0
    for i, (b, z) in enumerate(runs):
        if has[i, best]:
            out += [text[last:b], text[b:z].translate(exchange(*MAPPINGS[best]))]
            last = z
    return "".join(out) + text[last:], "{1}>{0}".format(*MAPPINGS[best])


def lost(text: str) -> bool:
    return "\ufffd" in text or "??" in text and LOST.search(text) is not None or text.count("?") > 1 and LOST.search(text) is not None


def restore(text: str, corpus: Corpus) -> tuple[str, str, str]:
    """(text, status, mappings): status is ``sound``, ``restored`` or ``lost``."""
    return next(restore_all([text], corpus))


def restore_all(texts: list[str], corpus: Corpus) -> Iterator[tuple[str, str, str]]:
    """:func:`restore` of many texts; their pairs are looked up together."""
    a = points("".join(f" {t} " for t in texts))
    at = corpus.places(a)
    begin = 0
    for text in texts:
        own, places = a[begin : begin + len(text) + 2], at[begin : begin + len(text) + 1]
        begin += len(text) + 2
        plain, path = text, ""
        runs = corpus.runs(own, places) if not text.isascii() and "\ufffd" not in text else []
        if runs:
            wide = places[places >= 0]
            if corpus.lead[wide].any():  # two signs that may begin a sequence of UTF-8
                out, last = [], 0
                for b, z in runs:
                    better, how = restore_run(text[b:z], corpus, text[b - 1 : b] or " ", text[z : z + 1] or " ")
                    out += [text[last:b], better]
                    last, path = z, path or how
                plain = "".join(out) + text[last:]
            if not path:
                plain, path = restore_single(text, places, runs, corpus)
        if lost(plain):
            yield plain, "lost", path
        else:
            yield (plain, "restored", path) if path else (text, "sound", "")


@tidy
def repair(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, status, mappings) of every row whose text is garbled, copies included.

    ``lost`` are texts in which characters were replaced (U+FFFD, or question marks in place of letters). Null,
    empty and ASCII texts without such marks are sound and give no row; equal texts come out alike.
    """
    h, h2 = F.xxhash64(text), F.xxhash64(text, F.lit(2))
    rows = df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text"), h.alias("h"), h2.alias("h2"))
    distinct, _ = cut(rows.select("h", "h2", "text").dropDuplicates(["h", "h2"]))  # copies go before the shuffle
    shared = df.sparkSession.sparkContext.broadcast(counts(distinct))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus(*shared.value)
        for b in batches:
            out = [[], [], [], [], []]
            for at in range(0, b.num_rows, 100):
                k, k2, texts = (b.column(i).slice(at, 100).to_pylist() for i in range(3))
                for k, k2, (plain, status, path) in zip(k, k2, restore_all(texts, corpus)):
                    if status != "sound":
                        for column, v in zip(out, (k, k2, plain, status, path)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:2]], *[pa.array(c, pa.string()) for c in out[2:]]], ["h", "h2", "restored", "status", "mappings"])

    # the tasks are set by cores and not by size: much work a text
    spread = distinct.where(F.col("text").rlike(r"[^\x00-\x7f]|\?")).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "h")
    found, _ = cut(spread.mapInArrow(run, "h long, h2 long, restored string, status string, mappings string"))
    copies = rows.where(F.col("text").rlike(r"[^\x00-\x7f]|\?")).select("key", "h", "h2")
    return copies.join(found, ["h", "h2"]).select(F.col("key").alias(key), "restored", "status", "mappings")
