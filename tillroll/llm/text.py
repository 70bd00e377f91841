"""Words and keys that several operators share.

A word is a maximal run of characters other than space, tab, line feed,
vertical tab, form feed and carriage return; only A-Z are lower-cased. On
UTF-8 bytes that is exactly ``bytes.lower().split()``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def byte_groups(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column of about ``limit`` bytes each (one row at least)."""
    start = size = 0
    lengths = [0 if n is None else n for n in pc.binary_length(column).to_pylist()]
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
