"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an
offset and a skip that come from hashes of its name. The shards take turns, each
claiming its first slot that is still free, until the table is full: every
shard then owns the same number of slots but for one, and when a shard is added
or removed few slots change owners besides its own. A row's shard is the owner
of the slot its key hashes to: one lookup in a table of fixed size, which is
broadcast whatever the data's size.

The table depends on the shard names alone and is built once, from ``slots``
claims; rows are placed with DataFrame functions only.

Defined cases: a null key hashes as the empty key; equal keys go to the same
shard; an empty table stays empty; columns named ``slot`` or ``shard`` are
replaced, all others pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation of the slots."""
    digest = hashlib.sha256(name.encode()).digest()
    offset, skip = (int.from_bytes(digest[i: i + 8], "little") for i in (0, 8))
    return offset % slots, skip % (slots - 1) + 1


def fill_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The owner (index into ``names``) of each slot."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shards need distinct names, at least one and at most one per slot")
    owner = [-1] * slots
    turns = [[*preference(name, slots)] for name in names]
    free = slots
    while free:
        for i, turn in enumerate(turns):
            at, skip = turn
            while owner[at] >= 0:
                at = (at + skip) % slots
            owner[at] = i
            turn[0] = (at + skip) % slots
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (index into ``names``) by ``key``."""
    owners = ",".join(map(str, fill_table(names, slots)))
    table = rows.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit(owners), ",")).alias("_slot", "_owner")).select(
        "_slot", F.col("_owner").cast("int").alias("_owner"))
    placed = rows.select(F.struct("*").alias("_row"), slot(F.col(key), slots).alias("_at"))
    keep = [F.col(f"_row.`{c}`") for c in rows.columns if c not in ("slot", "shard")]
    return placed.join(F.broadcast(table), F.col("_at") == F.col("_slot")).select(  # ``slots`` rows
        *keep, F.col("_at").alias("slot"), F.col("_owner").alias("shard"))


def write_shards(rows: DataFrame, key: str, names: list[str], path: str, slots: int = SLOTS) -> None:
    """Write ``rows`` under ``path``, one folder per shard. Each task writes to
    the shards of the rows it has, so no shard is gathered in one task."""
    assign_shards(rows, key, names, slots).drop("slot").write.partitionBy("shard").parquet(path)
