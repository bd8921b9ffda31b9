"""Encode texts with a public byte-level tokenizer (problem 8).

The rank file is a parameter and read once per Python worker. A text above ``split_at`` characters is cut at
boundaries no token of the pre-splitting pattern can span, so pieces encode to the same ids as the whole text.
Decoding joins the raw bytes of all ids before it reads them as UTF-8, since a token may hold part of a character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A token never runs from a sign that is no white space into white space.
SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pieces(text: str, size: int) -> Iterator[str]:
    """Cuts of ``text`` at safe boundaries, of about ``size`` characters; one with no boundary stays whole."""
    start = 0
    while len(text) - start > size:
        at = SAFE.search(text, start + size)
        if not at:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def encode_text(text: str | None, ranks: str = RANKS, split_at: int = 20_000) -> list[int]:
    """Ids of one text without special tokens; null and empty texts give the empty list."""
    if not text:
        return []
    enc = encoding(ranks)
    if len(text) <= split_at:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, split_at) for i in enc.encode_ordinary(p)]


def decode_ids(ids: list[int], ranks: str = RANKS) -> str:
    """The text of ``ids``, joined as bytes; ids that end inside a character give a replacement sign."""
    return b"".join(encoding(ranks).decode_tokens_bytes(ids)).decode("utf-8", errors="replace")


def encode(text: Column, ranks: str = RANKS, split_at: int = 20_000) -> Column:
    """``array<int>`` of token ids. Strings that look like special tokens are ordinary text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([encode_text(t, ranks, split_at) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def count(text: Column, ranks: str = RANKS, split_at: int = 20_000) -> Column:
    """Number of token ids; 0 for null and empty texts."""

    @F.arrow_udf("int")
    def sizes(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode_text(t, ranks, split_at)) for t in texts.to_pylist()], pa.int32())

    return sizes(text)


def decode(ids: Column, ranks: str = RANKS) -> Column:
    """The inverse of :func:`encode`; null stays null."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode_ids(x, ranks) for x in lists.to_pylist()], pa.string())

    return texts(ids)
