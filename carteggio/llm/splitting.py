"""Cut oversized texts at natural boundaries with an overlap (problem 4).

Every boundary of a text is joined to its farthest legal successor: the farthest paragraph end in reach, else line or
sentence end, else word end, each wanted in the second half of the reach first; where nothing is in reach the cut is
forced. The successor table is then squared again and again (``next = next[next]``), which finds all greedy cuts in
log(pieces) vectorised steps instead of walking from cut to cut. Texts are independent, so this runs where the rows
are, without a shuffle: a boundary table as rows would be several times the size of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
# The white space of Unicode, line ends, and the signs that end a sentence.
WHITE = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
LINE = np.array([0x0A, 0x0B, 0x0C, 0x85, 0x2028, 0x2029], dtype=np.uint32)
STOPS = np.array([ord(c) for c in ".!?;。"], dtype=np.uint32)
WIDE_STOPS = np.array([ord(c) for c in "。！？；"], dtype=np.uint32)
WORD, SENTENCE, PARAGRAPH = 1, 2, 3
NAMES = np.array(["forced", "word", "sentence", "paragraph", "end"])
FORCED, END = 0, 4


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions after which a text may be cut, their classes, and the longest stretch without any."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    white, stop = np.isin(a, WHITE), np.isin(a, STOPS)
    line = np.isin(a, LINE) | ((a == 13) & (np.append(a[1:], 0) != 10))
    rank = np.where(white | stop, WORD, 0)
    ends = np.flatnonzero(white & ~np.append(white[1:], False))  # the last sign of each run of white space
    begins = np.flatnonzero(white & ~np.append(False, white[:-1]))
    lines = np.append(0, np.cumsum(line))
    breaks = lines[ends + 1] - lines[begins]
    after = (begins > 0) & stop[np.maximum(begins - 1, 0)]
    rank[ends] = np.where(breaks >= 2, PARAGRAPH, np.where((breaks == 1) | after, SENTENCE, WORD))
    rank[np.isin(a, WIDE_STOPS)] = SENTENCE
    at = np.flatnonzero(rank)
    stretch = np.flatnonzero(white | stop)
    longest = int(np.diff(np.concatenate(([-1], stretch, [len(a)]))).max()) - 1
    return at + 1, rank[at], longest


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[str], int]:
    """End positions of the pieces, what each ends at, and the longest stretch without a boundary."""
    at, rank, longest = boundaries(text)
    n, step = len(text), limit - overlap
    inner = at < n
    pos, kind = np.concatenate(([0], at[inner], [n])), np.concatenate(([FORCED], rank[inner], [END]))
    gap = np.diff(pos)
    reach = np.full(len(gap), step)
    reach[0] = limit
    wide = np.flatnonzero(gap > reach)  # stretches that need forced cuts: one every ``step`` from their start
    if len(wide):
        extra = np.concatenate([np.arange(pos[i] + reach[i], pos[i + 1], step) for i in wide])
        pos, kind = np.concatenate((pos, extra)), np.concatenate((kind, np.zeros(len(extra), kind.dtype)))
        order = np.argsort(pos, kind="stable")
        pos, kind = pos[order], kind[order]
    reach = np.full(len(pos), step)
    reach[0] = limit
    here = np.arange(len(pos))
    last = np.searchsorted(pos, pos + reach, "right") - 1  # farthest node in reach
    nxt = last.copy()
    for least in (WORD, SENTENCE, PARAGRAPH):
        of = np.flatnonzero((kind >= least) & (kind < END))
        if len(of):
            far = of[np.maximum(np.searchsorted(of, last, "right") - 1, 0)]
            ok = (far > here) & (far <= last) & ((pos[far] - pos > reach // 2) | (least == WORD))
            nxt = np.where(ok, far, nxt)
    nxt = np.where(last == len(pos) - 1, last, nxt)
    reached, square = np.zeros(1, dtype=np.int64), nxt
    while True:
        more = np.union1d(reached, square[reached])
        if len(more) == len(reached):
            break
        reached, square = more, square[square]
    reached = reached[1:]
    return pos[reached].tolist(), NAMES[kind[reached]].tolist(), longest


def pieces(df: DataFrame, key: str = "id", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start_pos, end_pos, ends_at, cut, text) for every text above ``limit`` characters.

    Pieces count from 0; a piece after the first begins with the last ``overlap`` characters of the one before.
    ``cut`` is ``forced`` for texts with a stretch above ``limit`` without any boundary, else ``split``. Null, empty
    and short texts have no pieces; equal rows are cut alike.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = df.schema[key].dataType
    names = ["key", "piece", "start_pos", "end_pos", "ends_at", "cut", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, out = b.slice(at, 200), [[] for _ in names]
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ends, what, longest = cuts(t, limit, overlap)
                    begin = 0
                    for i, (e, w) in enumerate(zip(ends, what)):
                        s = max(0, begin - overlap) if i else 0
                        for column, v in zip(out, (k, i, s, e, w, "forced" if longest > limit else "split", t[s:e])):
                            column.append(v)
                        begin = e
                yield pa.RecordBatch.from_arrays([pa.array(out[0], part.column(0).type), *[pa.array(c, pa.int64()) for c in out[1:4]], *[pa.array(c, pa.string()) for c in out[4:]]], names)

    long = df.where(F.length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = long.mapInArrow(run, f"key {kind.simpleString()}, piece long, start_pos long, end_pos long, ends_at string, cut string, text string")
    return out.withColumnRenamed("key", key)
