"""Similarity clusters of vectors by grid density (problem 6).

Two vectors are similar if their cosine is at least ``least``; a cluster is a connected set of at least ``smallest``
rows. Features are the main directions of a bounded sample; a grid quantises them. SQL counts the rows of every cell,
gathers cells of neighbouring slabs into blocks of bounded size (dense slabs are divided into several), takes the
box of features of each block, and joins the blocks whose boxes are near enough to hold a similar pair: the distance
of two vectors is at least that of their projections. Within a block rows are linked cell by cell, then across
cells; joined blocks are compared set by set, where centres farther apart than the radii and the angle of ``least``
allow are skipped. Every link is an exact cosine and no similar pair is out of reach, so the result equals brute force at
every size. Smallest labels spread over the links to convergence; the typical rows of a cluster lie in its densest cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carteggio.operators.graph import connected_components
from carteggio.session import cut, tidy

LEAST, SMALLEST = 0.8, 5
#: Directions of the grid and cell width, leading directions that place a cell in a slab, rows of the sample.
DIRECTIONS, WIDTH, SLAB, SAMPLE = 8, 0.4, 3, 4096
#: Bytes of vectors in a block, and blocks of a model at least (so that small tables use all cores).
BLOCK, BLOCKS = 1 << 24, 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def usable(df: DataFrame, key: str = "id", model: str = "model_name", vector: str = "embedding") -> DataFrame:
    """(id, model, vec) of the rows with a finite, non-zero vector of the model's usual length.

    The usual length of a model is its most frequent one, the longer one on a tie. Rows without model are left out.
    """
    rows = df.where(F.col(model).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(model).alias("model"), F.col(vector).cast("array<float>").alias("vec"))
    usual = rows.groupBy("model", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).groupBy("model").agg(F.max(F.struct("n", "dim"))["dim"].alias("dim"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.join(F.broadcast(usual), "model").where((F.size("vec") == F.col("dim")) & (F.col("dim") > 0) & fine).select("id", "model", "vec")


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def directions(vectors: np.ndarray, n: int) -> np.ndarray:
    """Main directions of a sample as columns."""
    return np.linalg.svd(unit(vectors), full_matrices=False)[2][:n].T.copy()


def quantise(v: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, slab, cell) of unit vectors: projections and the length of the rest; keys of the leading steps and of all.

    The length of the rest is a feature like the others: no two vectors are nearer than their lengths differ.
    """
    f = v @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", f, f)))
    steps = np.floor(f / WIDTH + 0.5).astype(np.int64)
    slab = np.zeros(len(v), dtype=np.int64)
    for i in range(min(SLAB, steps.shape[1])):
        slab = slab * 16 + steps[:, i] + 8  # few steps in each direction: unit vectors lie between -1 and 1
    h = np.zeros(len(v), dtype=np.uint64)
    for i in range(steps.shape[1]):
        h = (h ^ steps[:, i].view(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return np.column_stack((f, rest)).astype(np.float32), slab, h.view(np.int64)


def link(v: np.ndarray, least: float) -> np.ndarray:
    """For each row of unit vectors the first row of its connected set, by search from visited to unvisited rows."""
    n, floor = len(v), least - 1e-9
    label, open_ = np.full(n, -1), np.ones(n, dtype=bool)
    for i in range(n):
        if not open_[i]:
            continue
        open_[i], label[i], front = False, i, np.array([i])
        while len(front):
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            front = rest[(v[rest] @ v[front].T >= floor).any(axis=1)]
            open_[front], label[front] = False, i
    return label


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Whole groups of sorted batches: rows with equal ``column`` never fall into two tables."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        c = t.column(column).to_numpy()
        last = int(np.searchsorted(c, c[-1], "left")) if len(c) else 0
        if last:
            yield t.slice(0, last)
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held


@tidy
def groups(column: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of equal values."""
    cuts = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def vectors_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of the column ``vec``."""
    vec = t.column("vec").combine_chunks()
    return vec.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(vec.offsets.to_numpy()))))


def inner_sets(v: np.ndarray, cell: np.ndarray, ids: np.ndarray, least: float) -> np.ndarray:
    """For each row of a block (sorted by cell) the smallest id of its connected set in the block."""
    root = np.empty(len(v), dtype=np.int64)
    for a, z in groups(cell):
        root[a:z] = a + link(v[a:z], least) if z - a > 1 else a
    parent = np.arange(len(v))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in touching(v, root, np.zeros(len(v), dtype=np.int64), least):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([top(i) for i in root.tolist()])
    first = np.full(len(v), np.iinfo(np.int64).max)
    np.minimum.at(first, root, ids)
    return first[root]


def gridded(df: DataFrame) -> DataFrame:
    """(id, model, vec, f, slab, cell) of (id, model, vec), on the main directions of about SAMPLE rows a model."""
    counts = {r["model"]: r["n"] for r in df.groupBy("model").agg(F.count("*").alias("n")).collect()}  # a row a model
    axes = {}
    for m, n in counts.items():
        some = df.where((F.col("model") == m) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0)).select("vec").limit(2 * SAMPLE).toPandas()
        axes[m] = directions(np.stack(some["vec"].to_numpy()), DIRECTIONS) if len(some) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column("model").to_pylist())
            for m in np.unique(names):
                part = b.filter(pa.array(names == m))
                v = unit(part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1))
                f, slab, cell = quantise(v, axes[m] if axes.get(m) is not None else np.eye(v.shape[1])[:, :DIRECTIONS])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("model"), part.column("vec"), lists, pa.array(slab), pa.array(cell)], ["id", "model", "vec", "f", "slab", "cell"])

    return cut(df.select("id", "model", "vec").mapInArrow(run, "id long, model string, vec array<float>, f array<float>, slab long, cell long"))[0]


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`gridded` plus ``block``: slabs in their order until a block is full; a slab above that is divided by cells.

    Slabs are few (a fixed number of steps in SLAB directions a model), so their order is a small table.
    """
    slabs = rows.groupBy("model", "slab").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))
    whole = slabs.groupBy("model").agg(F.greatest(F.least(F.ceil(F.sum("n") / BLOCKS), F.ceil(BLOCK / 4 / F.max("dim"))), F.lit(1)).alias("most"))
    order = Window.partitionBy("model").orderBy("slab")
    places = slabs.join(whole, "model").withColumn("parts", F.ceil(F.col("n") / F.col("most")))
    full = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    places = places.withColumn("run", F.when(F.col("parts") > 1, F.concat(F.lit("s"), F.col("slab").cast("string"))).otherwise(F.concat(F.lit("r"), F.floor(full / F.col("most")).cast("string"))))
    places, _ = cut(places.select("model", "slab", "run", "parts"))
    part = F.pmod(F.xxhash64("cell"), F.col("parts"))
    # one cell may be denser than a block: its rows are then told apart by their ids
    crowd = rows.join(places.where("parts > 1"), ["model", "slab"]).groupBy("model", "cell").agg(F.count("*").alias("n"), F.first("slab").alias("slab"))
    crowd = crowd.join(whole, "model").where("n > most").select("model", "cell", F.ceil(F.col("n") / F.col("most")).alias("salts"))
    out = rows.join(F.broadcast(places), ["model", "slab"]).join(crowd, ["model", "cell"], "left")  # slabs: a bounded table
    salt = F.when(F.col("salts").isNotNull(), F.concat(F.col("cell").cast("string"), F.lit("#"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("string"))).otherwise(part.cast("string"))
    return out.select("id", "model", "vec", "f", "cell", F.xxhash64("model", "run", salt).alias("block"))


def near_blocks(rows: DataFrame, least: float) -> DataFrame:
    """(block, pair, side): every pair of different blocks of a model whose boxes of features may hold a similar pair."""
    n = DIRECTIONS + 1
    at = lambda f, i: f(F.get("f", F.lit(i)))
    boxes = rows.groupBy("model", "block").agg(*[at(F.min, i).alias(f"lo{i}") for i in range(n)], *[at(F.max, i).alias(f"hi{i}") for i in range(n)])
    boxes, _ = cut(boxes)
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = sum((F.pow(F.greatest(F.coalesce(F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.lit(0.0)), F.coalesce(F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.lit(0.0)), F.lit(0.0)), 2) for i in range(n)), F.lit(0.0))
    pairs = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.block") < F.col("b.block"))).where(gap <= 2 * (1 - least) + 1e-4)
    pairs = pairs.select(F.col("a.block").alias("x"), F.col("b.block").alias("y"), F.xxhash64("a.block", "b.block").alias("pair"))
    pairs, _ = cut(pairs)
    return pairs.select(F.col("x").alias("block"), "pair", F.lit(0).alias("side")).unionByName(pairs.select(F.col("y").alias("block"), "pair", F.lit(1).alias("side")))


def touching(v: np.ndarray, label: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of labels with a similar pair of rows across them, from unit vectors of two sides (0 and 1, or 0 alone).

    One pair of rows is enough for a pair of labels; with two sides only rows of different sides are compared.
    """
    order = np.lexsort((label, side))
    v, label, side = v[order], label[order], side[order]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(label) != 0) | (np.diff(side) != 0))))
    ends = np.append(begins[1:], len(v))
    own, part = label[begins], side[begins]
    centre = np.add.reduceat(v, begins, axis=0)
    norm = np.linalg.norm(centre, axis=1, keepdims=True)
    centre = np.where(norm > 1e-9, centre / np.maximum(norm, 1e-9), v[begins])
    radius = np.arccos(np.clip(np.minimum.reduceat(np.einsum("ij,ij->i", v, np.repeat(centre, ends - begins, axis=0)), begins), -1, 1))
    radius[ends - begins == 1] = 0
    two, floor = part.any(), least - 1e-9
    left = np.flatnonzero(part == 0)
    right = np.flatnonzero(part == 1) if two else left
    out, reach = set(), np.arccos(floor) + 1e-5
    for a in range(0, len(left), 512):
        some = left[a : a + 512]
        angle = np.minimum(radius[some][:, None] + radius[right][None, :] + reach, np.pi)
        near = (centre[some] @ centre[right].T >= np.cos(angle) - 1e-9) & (own[some][:, None] != own[right][None, :])
        if not two:
            near &= some[:, None] < right[None, :]
        for i, row in zip(some, near):
            wanted = right[row]
            if not len(wanted):
                continue
            at = np.concatenate([np.arange(begins[j], ends[j]) for j in wanted])
            for b in range(begins[i], ends[i], 64):
                hit = np.zeros(len(at), dtype=bool)
                for c in range(0, len(at), 8192):
                    hit[c : c + 8192] = (v[at[c : c + 8192]] @ v[b : min(b + 64, ends[i])].T >= floor).any(axis=1)
                if hit.any():
                    met = np.unique(label[at[hit]])
                    out.update((min(int(own[i]), int(m)), max(int(own[i]), int(m))) for m in met)
                    at = at[~np.isin(label[at], met)]
                    if not len(at):
                        break
    return sorted(out)


@tidy
def linked_sets(rows: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`gridded` with ``label``, the smallest id of their set in their block, and the links (a, b) between labels."""
    placed = blocked(rows).repartition("block").sortWithinPartitions("block", "cell")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(batches, "block"):
            block, cell, ids = (t.column(c).to_numpy() for c in ("block", "cell", "id"))
            flat, offset = vectors_of(t)
            label = np.concatenate([inner_sets(unit(flat[offset[a] : offset[z]].reshape(z - a, -1)), cell[a:z], ids[a:z], least) for a, z in groups(block)])
            yield from t.append_column("label", pa.array(label)).combine_chunks().to_batches()

    kind = "id long, model string, vec array<float>, f array<float>, cell long, block long, label long"
    sets, _ = cut(placed.mapInArrow(inside, kind))
    pairs = near_blocks(sets, least)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(batches, "pair"):
            pair, label, side = (t.column(c).to_numpy() for c in ("pair", "label", "side"))
            flat, offset = vectors_of(t)
            for a, z in groups(pair):
                met = touching(unit(flat[offset[a] : offset[z]].reshape(z - a, -1)), label[a:z], side[a:z], least)
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in met]), pa.array([m[1] for m in met])], ["a", "b"])

    met = sets.select("block", "label", "vec").join(pairs, "block").select("pair", "side", "label", "vec")
    links, _ = cut(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(across, "a long, b long").distinct())
    return sets.select("id", "cell", "label"), links


@tidy
def cluster(df: DataFrame, least: float = LEAST, smallest: int = SMALLEST, key: str = "id", model: str = "model_name", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Members (id, cluster_id) and clusters (cluster_id, model, size, typical).

    Equal vectors are searched once and count as often as they occur. ``cluster_id`` is the smallest id of the cluster;
    ``typical`` are the up to five smallest ids in the densest cell of the cluster. Null, all-zero, non-finite and short vectors are in no cluster.
    """
    fit, _ = cut(usable(df, key, model, vector).withColumns({"h": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(2))}))
    same = fit.groupBy("model", "h", "h2").agg(F.min("id").alias("rep"))
    copies, _ = cut(fit.select("id", "model", "h", "h2").join(same, ["model", "h", "h2"]).select("id", "model", "rep"))
    distinct = fit.join(copies.where("id = rep").select("id"), "id", "left_semi").select("id", "model", "vec")
    sets, links = linked_sets(gridded(distinct), least)
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "label")
    labels, _ = cut(sets.join(joined, "label", "left").select(F.col("id").alias("node"), "cell", F.coalesce("component", "label").alias("component")))
    members = copies.join(labels.withColumnRenamed("node", "rep"), "rep").select("id", "model", "cell", F.col("component").alias("cluster_id"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.first("model").alias("model")).where(F.col("size") >= smallest)
    members = members.join(sizes.select("cluster_id"), "cluster_id")
    members, _ = cut(members)
    density = members.groupBy("cluster_id", "cell").agg(F.count("*").alias("n"))
    densest = density.groupBy("cluster_id").agg(F.max(F.struct("n", "cell"))["cell"].alias("cell"))
    core = members.join(densest, ["cluster_id", "cell"])
    # five smallest ids of a core, at most five kept per group of ids before they meet
    few = core.groupBy("cluster_id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("g")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, 5).alias("ids"))
    typical = few.groupBy("cluster_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 5).alias("typical"))
    return members.select("id", "cluster_id"), sizes.join(typical, "cluster_id", "left").select("cluster_id", "model", "size", "typical")
