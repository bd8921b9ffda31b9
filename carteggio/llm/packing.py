"""Pack items into containers of fixed capacity by minimum bin slack (problem 9).

Items of equal size are interchangeable, so the packing is decided on the histogram of sizes: at most ``capacity``
rows, however many items there are. Each step anchors the largest remaining size and fills the rest of the
container by a subset-sum over the remaining multiset, as bits of one integer; counts are read back stage by stage.
The pattern found is used as often as the counts allow, so every step uses up at least one size and the number of
patterns is bounded by the sizes, not by the items. Items then find their place by their rank within their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carteggio.session import cut, tidy

SALT_ROWS = 200_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes whose sum comes closest to ``room`` from below, as size -> count.

    Sizes are offered in falling order and the search stops once ``room`` is met, so large items go first.
    """
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for s in sorted(counts, reverse=True):
        n = min(counts[s], room // s)
        if n <= 0:
            continue
        stages.append((s, n, reach))
        k, part = 1, n
        while part > 0:  # binary splitting of the count
            take = min(k, part)
            reach |= (reach << (s * take)) & mask
            part -= take
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for s, n, before in reversed(stages):
        for k in range(n + 1):
            if at - k * s >= 0 and before >> (at - k * s) & 1:
                if k:
                    used[s] = k
                at -= k * s
                break
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size -> count in one container, number of containers) until the histogram is used up."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    out = []
    while left:
        anchor = max(left)
        left[anchor] -= 1
        pattern = fill({s: n for s, n in left.items() if n}, capacity - anchor)
        left[anchor] += 1
        pattern[anchor] = pattern.get(anchor, 0) + 1
        times = min(left[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        out.append((pattern, times))
    return out


@tidy
def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, tokens, container_id, start) for every item of ``sizes``.

    Only items above ``capacity`` are split: into full containers and a rest that is packed with the others. Null,
    zero and negative sizes take no room and are left out. ``start`` is the offset within the container. Rows with
    equal keys are separate items.
    """
    spark = sizes.sparkSession
    # the sizes may be dear to work out, so they are written once
    items, _ = cut(sizes.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")))
    items = items.where("n > 0")
    full = F.floor(F.col("n") / capacity)
    items = items.select("key", F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.when(F.col("n") % capacity > 0, F.array(F.col("n") % capacity)).otherwise(F.array().cast("array<bigint>")))).alias("piece", "tokens"))
    histogram = {r["tokens"]: r["c"] for r in items.groupBy("tokens").agg(F.count("*").alias("c")).collect()}  # at most ``capacity`` rows
    start: dict[int, int] = dict.fromkeys(histogram, 0)
    slots, containers = [], 0
    for pattern, times in patterns(histogram, capacity):
        offset = 0
        for s, k in sorted(pattern.items(), reverse=True):
            slots.append((s, start[s], start[s] + k * times, k, containers, offset))
            start[s] += k * times
            offset += k * s
        containers += times
    kind = "tokens long, first long, last long, k long, base long, offset long"
    by_size = spark.createDataFrame(slots, kind).groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("first", "last", "k", "base", "offset"))).alias("slots"))
    salts = spark.createDataFrame([(s, 1 + n // SALT_ROWS) for s, n in histogram.items()], "tokens long, salts long")
    # rank within a size: hot sizes are cut into salted groups, whose counts give the offsets
    salted = items.join(F.broadcast(salts), "tokens").withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.col("salts")))
    groups = salted.groupBy("tokens", "salt").agg(F.count("*").alias("c"))
    before = groups.select("tokens", "salt", (F.sum("c").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("key", "piece")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(by_size, "tokens").withColumn("s", F.get(F.filter("slots", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["last"])), F.lit(0)))
    at = F.col("rank") - F.col("s.first")
    return placed.select(
        F.col("key").alias(key), F.col("piece").cast("long").alias("piece"), "tokens",
        (F.col("s.base") + F.floor(at / F.col("s.k"))).alias("container_id"), (F.col("s.offset") + F.pmod(at, F.col("s.k")) * F.col("tokens")).alias("start"),
    )
