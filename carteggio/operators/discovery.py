"""Entities, graphs and search over an archive."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carteggio.operators import terms
from carteggio.session import cut, tidy

# Mail services whose name is no entity, and letters with their plain form.
SERVICES = ("gmail", "outlook", "hotmail", "yahoo")
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def entity_of_domain(domain: Column) -> Column:
    """The first label of a domain as a name: hyphens to blanks, words capitalised; empty for mail services."""
    root = F.split_part(F.coalesce(domain, F.lit("")), F.lit("."), F.lit(1))
    return F.when(root.isin(*SERVICES), "").otherwise(F.initcap(F.replace(root, F.lit("-"), F.lit(" "))))


def slug(c: Column) -> Column:
    """Lower case, everything but letters and digits of ASCII to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: Bits of the filter that tells which runs of words can be names; fixed, whatever the number of entries.
FILTER = 23
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD = re.compile(r"(\w+)")  # the letters, digits and underscores of [\p{L}\p{N}_]


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) + 1


def _places(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the places in the filter of the runs of so many words, by their first word."""
    n = len(codes)
    power, back = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b)))) for b in (BASE, INVERSE))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * power[:-1])))
    for k in sizes:
        if k <= n:
            h = (sums[k:] - sums[:-k]) * back[: n - k + 1]
            yield k, ((h ^ (h >> np.uint64(29))) * BASE >> np.uint64(64 - FILTER)).astype(np.int64)


@tidy
def mentions(docs: DataFrame, doc: str, text: str, entries: DataFrame, entry: str, name: str) -> DataFrame:
    """(entry, doc): dictionary entries of any number of words that a text holds as whole words, case ignored.

    Every run of as many words as some entry has is looked up in a filter of fixed size made from the entries. Runs that
    pass, letters and signs between their words included, meet the entries that read the same, so texts are neither
    shuffled nor searched for each entry that shares a word with them. Null and wordless names match nothing.
    """
    spark = docs.sparkSession
    kind = entries.schema[entry].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [WORD.split(x) for x in b.column(1).to_pylist()]
            some = [i for i, s in enumerate(split) if len(s) > 1]
            split = [split[i] for i in some]
            place = [int(p[0]) for s in split for _, p in _places(np.array([_code(w) for w in s[1::2]], dtype=np.uint64), [len(s) // 2])]
            columns = [["".join(s[1:-1]) for s in split], [s[0] for s in split], [s[-1] for s in split], [len(s) // 2 for s in split], place]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())))], ["entry", "core", "left", "right", "size", "place"])

    names = entries.where(F.col(name).isNotNull()).select(F.col(entry).alias("entry"), F.lower(F.trim(name)).alias("name"))
    names, _ = cut(names.mapInArrow(read, f"entry {kind}, core string, left string, right string, size long, place long"))
    sizes = sorted(r["size"] for r in names.select("size").distinct().collect())  # different numbers of words in a name
    edge = names.agg(F.coalesce(F.max(F.length("left")), F.lit(0)).alias("left"), F.coalesce(F.max(F.length("right")), F.lit(0)).alias("right")).first()
    left, right = edge["left"] + 1, edge["right"] + 1
    set_bytes = names.groupBy(F.shiftright("place", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(place % 8 as int))")).alias("bits")).toArrow()
    filled = np.zeros(1 << FILTER - 3, dtype=np.uint8)
    filled[set_bytes["at"].to_numpy()] = set_bytes["bits"].to_numpy()
    packed = zlib.compress(filled.tobytes())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                part = b.slice(begin, 500)
                split = [WORD.split(x) for x in part.column(1).to_pylist()]
                size = np.array([len(s) // 2 for s in split])
                codes = np.fromiter(map(_code, chain.from_iterable(s[1::2] for s in split)), np.uint64, int(size.sum()))
                of, first = np.repeat(np.arange(len(split)), size), np.cumsum(size) - size
                found = set()
                for k, place in _places(codes, sizes):
                    hit = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1)
                    hit = hit[of[hit] == of[hit + k - 1]]
                    for i, at in zip(of[hit].tolist(), (2 * (hit - first[of[hit]])).tolist()):
                        s, end = split[i], at + 2 * k
                        # a blank stands for the border of the text: what a name's own signs leave of a gap is never empty then
                        before, after = s[at] if at else " " + s[0], s[end] if end < len(s) - 1 else s[end] + " "
                        found.add((i, "".join(s[at + 1 : end]), before[-left:], after[:right]))
                rows = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.string()) for c in rows[1:])], [doc, "core", "before", "after"])

    runs = docs.where(F.col(text).isNotNull()).select(doc, F.lower(text).alias("_t")).mapInArrow(find, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, core string, before string, after string")
    whole = F.endswith("before", F.col("left")) & (F.length("before") > F.length("left")) & F.startswith("after", F.col("right")) & (F.length("after") > F.length("right"))
    return runs.join(names.drop("size", "place"), "core").where(whole).select(F.col("entry").alias(entry), doc).distinct()


def graph(items: DataFrame, key: str, links: dict[str, Column]) -> DataFrame:
    """(source, target, edge_type): an edge from every value of each array column in ``links`` to its item."""
    out = None
    for kind, values in links.items():
        rows = items.select(F.col(key).alias("k"), F.explode(F.array_distinct(values)).alias("v")).where("v is not null and v <> ''")
        e = rows.select(F.concat(F.lit(f"{kind}:"), F.lower("v")).alias("source"), F.concat(F.lit("item:"), F.col("k").cast("string")).alias("target"), F.lit(f"{kind}_to_item").alias("edge_type"))
        out = e if out is None else out.unionByName(e)
    return out


def nodes(edges: DataFrame) -> DataFrame:
    """(node_id, node_type, frequency) of the sources of a graph."""
    return edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("frequency")).select("node_id", F.split_part("node_id", F.lit(":"), F.lit(1)).alias("node_type"), "frequency")


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), *ACCENTS)


def snippet(text: Column, word: str, around: int = 60) -> Column:
    """The first occurrence of a word (accents and case ignored) in brackets with what stands around it."""
    at = F.regexp_instr(folded(text), F.lit(rf"(?<![a-z0-9]){word}(?![a-z0-9])"))
    start = F.greatest(at - around, F.lit(1))
    cut = F.concat(
        F.when(start > 1, "… ").otherwise(""), F.substr(text, start, at - start), F.lit("["), F.substr(text, at, F.lit(len(word))), F.lit("]"),
        F.substr(text, at + len(word), F.lit(around)), F.when(at + len(word) + around <= F.length(text), " …").otherwise(""),
    )
    return F.when(at > 0, F.regexp_replace(cut, r"\s+", " "))


def build_index(docs: DataFrame, doc: str, text: str, path: str, parts: int = 64) -> None:
    """An inverted index below ``path``: postings by hash of the term, lengths, and one row of corpus figures."""
    counts = terms.term_counts(docs.where(F.col(text).isNotNull()), doc, F.regexp_extract_all(folded(F.col(text)), F.lit("([a-z0-9]{2,})"), 1))
    bucket = F.pmod(F.xxhash64("term"), F.lit(parts)).alias("bucket")
    length = counts.groupBy(doc).agg(F.sum("tf").alias("len"))
    postings = counts.select(doc, "term", "tf", bucket).join(length, doc)
    postings.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    length.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{path}/corpus")


def search(spark: SparkSession, path: str, doc: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) by BM25 from an index; only the folders of the query's terms are read. Every term must occur."""
    corpus = spark.read.parquet(f"{path}/corpus")
    parts = corpus.first()["parts"]
    asked = sorted({t.lower().translate(str.maketrans(*ACCENTS)) for t in query})
    places = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(parts)).alias(f"b{i}") for i, t in enumerate(asked)]).first()
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*set(places)) & F.col("term").isin(*asked))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(corpus.select("n", "mean")))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(doc).agg(F.sum(part).alias("score"), F.count("*").alias("hits")).where(F.col("hits") == len(asked)).drop("hits")


def requested(df: DataFrame, key: str, ids: DataFrame, order: str = "pos") -> DataFrame:
    """The rows asked for by ``ids`` (key, order), with their place; an id asked for twice comes twice. Sort by ``order``."""
    return ids.join(df, key)
