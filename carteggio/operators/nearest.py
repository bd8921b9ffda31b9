"""The texts nearest to some of the texts by TF-IDF, exact, by products of blocks of vectors.

Texts are packed into blocks of sparse counts where they are read; blocks of queries meet blocks of targets in the cells
of a grid, so only packed counts are shuffled, never pairs. Products of vectors projected on the main directions of the
targets, with what the projection leaves out as a further component, bound every similarity from above; what may be among
the best is worked out again in double precision.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carteggio.operators.relational import top_k
from carteggio.session import cut, tidy

#: Targets and queries of a block, hints with blocks of their own in a task, and blocks of one cell of the grid.
TARGETS, ASKED, HINTS, CELL_TARGETS, CELL_ASKED = 2048, 2048, 32, 64, 256
#: Sets of main directions, directions of one, share of the squared lengths that they may leave out, targets of one product.
BASES, DIRECTIONS, LEFT, WIDE = 16, 128, 1e-3, 1024
#: More than single precision can be off, in a product and in a squared length.
SLACK, ROUNDED = 2e-4, 1e-5


def _pack(ids: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.asarray(x, t).tobytes() for x, t in (([len(ids), len(term)], "<i8"), (ids, "<i8"), (size, "<i4"), (term, "<i4"), (tf, "<i4"))), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2)
    out, at = [], 16
    for count, kind in ((n, "<i8"), (n, "<i4"), (m, "<i4"), (m, "<i4")):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of the runs."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Vectors:
    """Unit vectors of a block; with ``keep`` equal ones are one vector with the smallest ids of it."""

    def __init__(self, parts: list[list[np.ndarray]], idf: np.ndarray, keep: int | None = None):
        ids, size, term, tf = (np.concatenate(x) for x in zip(*parts))
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        if keep:
            seen: dict[bytes, list[int]] = {}
            for i, (a, n) in enumerate(zip(start.tolist(), size.tolist())):
                seen.setdefault(term[a : a + n].tobytes() + tf[a : a + n].tobytes(), []).append(i)
            first = np.array([x[0] for x in seen.values()], dtype=np.int64)
            few = [sorted(ids[x].tolist())[:keep] for x in seen.values()]
            ids, self.copies = np.array([i for x in few for i in x], dtype=np.int64), np.array([len(x) for x in few], dtype=np.int64)
            at = _spread(start[first], size[first])
            term, tf, size = term[at], tf[at], size[first]
            start = np.cumsum(size) - size
        self.ids, self.size, self.start, self.term, self.terms = ids, size, start, term, len(idf)
        self.n = len(size)
        row, w = np.repeat(np.arange(self.n), size), tf * idf[term]
        self.weight = w / np.sqrt(np.bincount(row, w * w, self.n))[row]

    def dense(self, rows: np.ndarray | slice = slice(None), kind: type = np.float32) -> np.ndarray:
        start, size = self.start[rows], self.size[rows]
        at, out = _spread(start, size), np.zeros((len(size), self.terms), dtype=kind)
        out[np.repeat(np.arange(len(size)), size), self.term[at]] = self.weight[at]
        return out

    def project(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors in the directions of ``basis`` and, last, the length of the rest; the lengths of both."""
        return _with_rest(np.concatenate([self.dense(slice(x, x + ASKED)) @ basis for x in range(0, self.n, ASKED)]))


def _with_rest(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    square = (inside.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(1 - square, 0) + ROUNDED)
    return np.hstack([inside, rest[:, None].astype(np.float32)]), np.sqrt(square), rest


def _directions(vectors: _Vectors) -> np.ndarray:
    """An orthonormal basis that leaves little of these vectors out; any basis bounds right, a good one bounds closely."""
    every = vectors.dense(kind=np.float64)
    used = np.flatnonzero(every.any(axis=0))
    value, vector = np.linalg.eigh(every[:, used].T @ every[:, used])
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    wanted = int(np.searchsorted(np.cumsum(value), (1 - LEFT) * value.sum())) + 1
    out = np.zeros((vectors.terms, min(wanted, DIRECTIONS, len(used))), dtype=np.float32)
    out[used] = vector[:, : out.shape[1]]
    return out


class _Targets:
    """Targets of one set of directions, those that it leaves least out first."""

    def __init__(self, parts: list[list[np.ndarray]], idf: np.ndarray, keep: int, basis: np.ndarray):
        self.vectors = _Vectors(parts, idf, keep)
        point, inside, rest = self.vectors.project(basis)
        order = np.argsort(rest, kind="stable")
        self.groups = [(x, np.ascontiguousarray(point[x].T), inside[x].max(), rest[x].max()) for x in np.split(order, range(WIDE, len(order), WIDE))]


class _Best:
    """The best targets so far of each query of a block."""

    def __init__(self, asked: _Vectors, k: int):
        self.asked, self.k, self.least = asked, k, np.zeros(asked.n)
        self.row, self.target, self.value = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.least[rows] - SLACK, np.finfo(np.float32).tiny).astype(np.float32)

    def meet(self, to: _Targets, point: np.ndarray, inside: np.ndarray, rest: np.ndarray) -> None:
        """``point``, ``inside``, ``rest``: of the queries in the targets' directions."""
        few = 2 * (self.k + 1)
        for place, columns, most, most_rest in to.groups:
            rows = np.flatnonzero(inside * most + rest * most_rest >= self.least - SLACK)
            if not len(rows):
                continue
            bound = (point if len(rows) == len(point) else point[rows]) @ columns
            near = bound >= self.reach(rows)[:, None]
            count = np.count_nonzero(near, axis=1)
            full = np.flatnonzero(count > 2 * few)
            if len(full):  # the likeliest first, so that others can be told to be too far
                likely = np.argpartition(bound[full], -few, axis=1)[:, -few:]
                self.add(np.repeat(rows[full], few), place[likely.ravel()], to.vectors)
                bound[np.repeat(full, few), likely.ravel()] = -1
                near[full] = bound[full] >= self.reach(rows[full])[:, None]
                count[full] = np.count_nonzero(near[full], axis=1)
            i, j = np.divmod(np.flatnonzero(near), len(place))
            many = count > len(place) // 16
            if count[many].sum() > 20_000:  # the bound says little here
                sparse, wide = ~many[i], np.flatnonzero(many)
                close = self.asked.dense(rows[wide]) @ to.vectors.dense(place).T
                a, b = np.nonzero((close >= self.reach(rows[wide])[:, None]) & near[wide])
                i, j = np.concatenate((i[sparse], wide[a])), np.concatenate((j[sparse], b))
            for begin in range(0, len(i), 50_000):
                self.add(rows[i[begin : begin + 50_000]], place[j[begin : begin + 50_000]], to.vectors)

    def add(self, row: np.ndarray, vector: np.ndarray, to: _Vectors) -> None:
        if not len(row):
            return
        q, value = self.asked, np.zeros(len(row))
        for begin in range(0, len(row), 5000):
            r, v = row[begin : begin + 5000], vector[begin : begin + 5000]
            rows, at = np.unique(r, return_inverse=True)
            table = q.dense(rows, np.float64)
            size = to.size[v]
            place = _spread(to.start[v], size)
            value[begin : begin + 5000] = np.add.reduceat(table.ravel().take(np.repeat(at * q.terms, size) + to.term[place]) * to.weight.take(place), np.cumsum(size) - size)
        good = value >= np.maximum(self.least[row] - 1e-8, np.finfo(np.float64).tiny)
        row, vector, value = row[good], vector[good], value[good]
        copies = to.copies[vector]
        target = to.ids[_spread((np.cumsum(to.copies) - to.copies)[vector], copies)]
        row, value = np.repeat(row, copies), np.repeat(value, copies)
        other = target != q.ids[row]
        row, target, value = (np.concatenate((x, y[other])) for x, y in ((self.row, row), (self.target, target), (self.value, value)))
        order = np.lexsort((target, -np.round(value, 9), row))
        row, target, value = row[order], target[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        full = rank == self.k - 1
        np.maximum.at(self.least, row[full], value[full])
        best = rank < self.k
        self.row, self.target, self.value = row[best], target[best], value[best]


@tidy
def nearest(docs: DataFrame, doc: str, text: str, word: str, asked: Column, hint: str, size: int = 1000, k: int = 5) -> DataFrame:
    """(source, target, similarity): the ``k`` other texts nearest to each of those that ``asked`` selects, by cosine.

    Weights are those of :func:`terms.tfidf` over the ``size`` most frequent terms, matches of ``word`` in the lower-case
    text. Texts are compared with all others; ``hint``, such as their language, only says which ones share a block, which
    saves work where they share most terms. Ties (to nine digits) go to the smaller id, texts without a common term
    are no neighbours, rows of one id are one text.
    """
    pattern = re.compile(word)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.lower(text).alias("text"), F.col(hint).cast("string").alias("hint"), F.coalesce(asked, F.lit(False)).alias("asked"))
    total = rows.groupBy("doc").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if total["most"] > 1:
        rows = rows.groupBy("doc").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"), F.min("hint").alias("hint"), F.max("asked").alias("asked"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            freq, df = Counter(), Counter()
            for x in b.column(0).to_pylist():
                words = pattern.findall(x)
                freq.update(words)
                df.update(set(words))
            yield pa.RecordBatch.from_arrays([pa.array(list(freq), pa.string()), pa.array(list(freq.values()), pa.int64()), pa.array([df[w] for w in freq], pa.int64())], ["term", "freq", "df"])

    stats = rows.select("text").mapInArrow(count, "term string, freq long, df long").groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df"))
    stats = stats.orderBy(F.col("freq").desc(), "term").limit(size).collect()  # ``size`` rows
    number = {r["term"]: i for i, r in enumerate(stats)}
    idf = np.log((1 + total["n"]) / (1 + np.array([r["df"] for r in stats], dtype=np.float64))) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        serial, get = Counter(), number.get

        def block(key: tuple) -> pa.RecordBatch:
            # blocks of a hint come in turns to the lines of the grid
            serial[key] += 1
            no = TaskContext.get().partitionId() + serial[key] + zlib.crc32(str(key[1]).encode()) % 1009
            parts = [np.concatenate(x) for x in zip(*waiting.pop(key))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, no, len(parts[0]), _pack(*parts)), (pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["asks", "hint", "no", "docs", "blob"])

        for b in batches:
            for begin in range(0, b.num_rows, ASKED):
                part = b.slice(begin, ASKED)
                found = [[i for i in map(get, pattern.findall(x)) if i is not None] for x in part.column(1).to_pylist()]
                of = np.repeat(np.arange(len(found)), [len(x) for x in found])
                both, tf = np.unique(of * size + np.array([i for x in found for i in x], dtype=np.int64), return_counts=True)
                of, term = both // size, both % size
                n = np.bincount(of, minlength=len(found))
                start = np.cumsum(n) - n
                ids, asks = part.column(0).to_pylist(), np.array(part.column(3).to_pylist(), dtype=bool)
                some = (n > 0) & np.array([i is not None for i in ids], dtype=bool)
                hints = [h if (False, h) in waiting or len(waiting) < 2 * HINTS else None for h in part.column(2).to_pylist()]
                members: dict[str | None, list[int]] = {}
                for i in np.flatnonzero(some).tolist():
                    members.setdefault(hints[i], []).append(i)
                for h, m in members.items():
                    every = np.array(m)
                    for a, at in ((False, every), (True, every[asks[every]])):
                        if len(at):
                            place = _spread(start[at], n[at])
                            held = waiting.setdefault((a, h), [])
                            held.append((np.array([ids[i] for i in at.tolist()], dtype=np.int64), n[at], term[place], tf[place]))
                            if sum(len(x[0]) for x in held) >= (ASKED if a else TARGETS):
                                yield block((a, h))
        for key in list(waiting):
            yield block(key)

    blocks, _ = cut(rows.mapInArrow(pack, "asks boolean, hint string, no long, docs long, blob binary"))
    held = {r["asks"]: r for r in blocks.groupBy("asks").agg(F.sum("docs").alias("docs"), F.count("*").alias("blocks"), F.sum(F.length("blob")).alias("bytes")).collect()}
    if len(held) < 2:
        return docs.sparkSession.createDataFrame([], "source long, target long, similarity double")
    # a block of each hint, of the commonest hints, shows the main directions; they change the work and not the result
    shown = blocks.where("not asks").groupBy("hint").agg(F.sum("docs").alias("docs"), F.max_by("blob", F.struct("docs", "no")).alias("blob")).orderBy(F.col("docs").desc(), "hint").limit(BASES).collect()
    names, bases = [r["hint"] for r in shown], [_directions(_Vectors([_unpack(r["blob"])], idf)) for r in shown]
    every, ends = np.hstack(bases), np.cumsum([x.shape[1] for x in bases])[:-1]
    # few columns for the queries, which are projected in each, and rows enough to keep all cores busy
    least, (asks, targets) = 4 * docs.sparkSession.sparkContext.defaultParallelism, (held[True], held[False])
    across = min(targets["blocks"], max(-(-targets["docs"] // (CELL_TARGETS * TARGETS)), round((least * targets["bytes"] / asks["bytes"] / 2) ** 0.5), 1))
    down = min(asks["blocks"], max(-(-asks["docs"] // (CELL_ASKED * ASKED)), -(-least // across)))
    line = F.when(F.col("asks"), F.pmod("no", F.lit(down))).otherwise(F.pmod("no", F.lit(across)))
    # queries go to every cell of their row of the grid, targets to every cell of their column
    to = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: line * across + i)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: i * across + line))
    cells = blocks.select("asks", "hint", "blob", F.explode(F.transform(to, lambda x: x.cast("int"))).alias("cell")).repartitionById(down * across, "cell").sortWithinPartitions("cell", "asks", "hint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, bases = {h: i for i, h in enumerate(names)}, np.split(every, ends, axis=1)
        cell, asker, waiting, held, targets = None, None, [], {}, {}

        def ready() -> None:
            for h, parts in held.items():
                of = which.get(h, 0)
                while parts:
                    some = [parts.pop()]
                    while parts and sum(len(x[0]) for x in some) + len(parts[-1][0]) <= 4 * TARGETS:
                        some.append(parts.pop())
                    targets.setdefault(of, []).append(_Targets(some, idf, k + 1, bases[of]))
            held.clear()

        def results() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            x, own = _Best(_Vectors(waiting, idf), k), which.get(asker, 0)
            waiting.clear()
            points = np.split(x.asked.dense() @ every, ends, axis=1)
            for of in sorted(targets, key=lambda t: t != own):  # those of the same hint first
                point = _with_rest(points[of])
                for to in targets[of]:
                    x.meet(to, *point)
            yield pa.RecordBatch.from_arrays([pa.array(x.asked.ids[x.row]), pa.array(x.target), pa.array(x.value)], ["source", "target", "similarity"])

        for b in batches:
            for i in range(b.num_rows):
                asks, hint, blob, at = (b.column(c)[i].as_py() for c in range(4))
                parts = _unpack(blob)
                if waiting and (at != cell or hint != asker or sum(len(x[0]) for x in waiting) + len(parts[0]) > ASKED):
                    yield from results()
                if at != cell:
                    cell, held, targets = at, {}, {}
                if asks:
                    ready()
                    asker = hint
                    waiting.append(parts)
                else:
                    held.setdefault(hint, []).append(parts)
        yield from results()

    pairs = cells.mapInArrow(compare, "source long, target long, similarity double")
    return top_k(pairs, ["source"], [F.round("similarity", 9).desc(), F.col("target")], k).drop("rank")
