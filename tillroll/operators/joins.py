"""Broadcast only what a size check allows; filter before a shuffle.

``bounded_broadcast`` marks a side for broadcast after counting its rows (a
count reads parquet footers and sends one number per task, no rows) and
multiplying by the width of a row; beyond either bound the side is returned
as is and Spark plans the join by its own size checks. Sides that grow with
the data carry no hint at all.

``might_be_in`` keeps the rows whose key may be among wanted keys, by a Bloom
filter in blocks: a key's hash chooses one of ``blocks`` blocks and one bit in each
of its eight 32-bit words. Building it is one aggregate (a bitwise OR per block and
word, combined map-side); testing it is a broadcast join by block of at most
``blocks`` rows of 40 bytes, whatever the number of keys. More keys only let more rows
through, so an exact join must follow; it then shuffles few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEFAULT_MAX_ROWS = 100_000
DEFAULT_MAX_BYTES = 32 << 20
TEXT_BYTES = 64  # taken for the width of a text


def row_bytes(df: DataFrame) -> int:
    """Width of a row: eight bytes a column, more for text."""
    return sum(TEXT_BYTES if isinstance(f.dataType, StringType) else 8 for f in df.schema.fields)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                      max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``F.broadcast(df)`` when ``df`` has at most ``max_rows`` rows and about
    ``max_bytes`` bytes; else ``df`` itself."""
    rows = df.count()
    if rows <= max_rows and rows * row_bytes(df) <= max_bytes:
        return F.broadcast(df)
    return df


WORDS = 8
DEFAULT_BLOCKS = 1 << 16  # 2.6 MB; about one key in a hundred passes wrongly at 1.6 million wanted keys


def _bits(keys: Sequence[str], blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each word."""
    h = F.xxhash64(*keys)
    place = [F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int") for k in range(WORDS)]
    bits = [F.call_function("shiftleft", F.lit(1), p) for p in place]
    return F.pmod(F.shiftrightunsigned(h, 5 * WORDS), F.lit(blocks)).cast("int"), bits


def might_be_in(df: DataFrame, wanted: DataFrame, keys: Sequence[str], blocks: int = DEFAULT_BLOCKS) -> DataFrame:
    """The rows of ``df`` whose ``keys`` may be among those of ``wanted``: all
    that are, and few others. Keys have the same types on both sides; a NULL is a value like others."""
    block, bits = _bits(keys, blocks)
    names = [f"_word_{k}" for k in range(WORDS)]
    words = wanted.select(block.alias("_block"), *(b.alias(n) for b, n in zip(bits, names, strict=True)))
    words = words.groupBy("_block").agg(*(F.bit_or(n).alias(n) for n in names))
    fits = reduce(lambda a, b: a & b, (F.col(n).bitwiseAND(b) == b for n, b in zip(names, bits, strict=True)))
    return df.join(F.broadcast(words), (block == F.col("_block")) & fits, "left_semi")
