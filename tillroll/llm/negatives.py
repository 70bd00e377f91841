"""Hard-negative mining with exact Four-Russians scores.

Vectors are integers, floor(scale * component). A block of candidates is packed
by bit planes: for every plane of the two's complement and every group of eight
dimensions, one byte per row holds that bit of its eight components. For an
anchor, a table per group holds the sum of its components over each of the 256
subsets of the group. The inner product is then shifts and additions of table
entries looked up by those bytes, the sign plane counted negatively; sums are
taken modulo 2^64, in which every score fits, so they are exact.

Two passes over blocks of candidates and blocks of anchors (a stated query set
against all rows; nothing else is crossed). The first keeps the best ``positives``
rows of the anchor's own label, the second, for each of those, the best
``negatives`` rows of other labels whose score lies between ``low`` and ``high``
percent of the positive's. A block keeps only that many rows an anchor, and a
ranking per anchor keeps the best of those; no group is by label, so a label
with a third of all rows is spread like any other.

Defined cases: rows whose id, label or vector is null, whose vector is empty or
holds a null or non-finite component, or whose squared length in those integers
reaches 2^62 (a score might not fit a long) take no part; an anchor meets only
vectors of its own length; an anchor's other rows are those of another id, so
rows that repeat an id are anchors of their own but never each other's
candidates; ties go to the smaller vec_id; a negative positive score has no
negatives, as its band is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.store import materialize

BLOCK = 4096         # candidates in a block
ANCHORS = 512        # anchors in a block
STRIP = 256          # candidates scored at once
GROUP = 8
LEAST = np.iinfo(np.int64).min

ROW = "row long, vec_id long, label long, v array<long>"
CANDIDATES = "dim int, planes int, ids binary, labels binary, bits binary"
QUERIES = "dim int, rows binary, ids binary, labels binary, matrix binary, bands binary"


def _matrix(rows: list, dim: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros to whole groups."""
    out = np.zeros((len(rows), -(-dim // GROUP) * GROUP), np.int64)
    out[:, :dim] = np.concatenate(rows).reshape(-1, dim)
    return out


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of the two's complement of ``x`` (rows, dims), lowest plane first."""
    largest = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)), 0)
    planes = largest.bit_length() + 1
    groups = x.T.reshape(-1, GROUP, len(x))
    return np.stack([np.packbits(((groups >> p) & 1).astype(np.uint8), axis=1, bitorder="little")[:, 0]
                     for p in range(planes)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of an anchor's components over the subsets of each group."""
    parts = anchors.T.reshape(-1, GROUP, len(anchors))
    sums = np.zeros((len(parts), 1 << GROUP, len(anchors)), np.int64)
    for j in range(GROUP):
        sums[:, 1 << j:2 << j] = sums[:, :1 << j] + parts[:, j, None]
    return sums


def scores(sums: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products by table lookups, shifts and additions."""
    planes, groups, rows = bits.shape
    out, taken = np.empty((rows, sums.shape[2]), np.int64), np.empty((rows, sums.shape[2]), np.int64)
    for p in range(planes - 1, -1, -1):
        if p == planes - 1:
            out[:] = 0
        else:
            np.left_shift(out, 1, out=out)
        for g in range(groups):
            np.take(sums[g], bits[p, g], axis=0, out=taken, mode="clip")
            (np.subtract if p == planes - 1 else np.add)(out, taken, out=out)
    return out


def _blocks(limit: int, block, schema: str):
    """Rows (row, vec_id, label, v, ...) -> one row per block of vectors of one length."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        def out(dim):
            values = block(waiting.pop(dim), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in values], names)

        waiting: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() if k != 3 else c for k, c in enumerate(batch.columns)), strict=True):
                v = row[3].values.to_numpy(zero_copy_only=False)
                waiting.setdefault(len(v), []).append((*row[:3], v, *row[4:]))
                if len(waiting[len(v)]) == limit:
                    yield out(len(v))
        for dim in list(waiting):
            yield out(dim)
    return run


def _longs(values) -> bytes:
    return np.array(values, "<i8").tobytes()


def _candidates(rows: list, dim: int):
    rows.sort(key=lambda r: r[1])  # by id: of equal scores the first is the smallest id
    bits = bit_planes(_matrix([r[3] for r in rows], dim))
    return dim, len(bits), _longs([r[1] for r in rows]), _longs([r[2] for r in rows]), bits.tobytes()


def _queries(rows: list, dim: int):
    """``bands``: per anchor and positive the least and the greatest score of a negative."""
    bands = [r[4] or [] for r in rows] if len(rows[0]) > 4 else [[]] * len(rows)
    width = max(map(len, bands))
    flat = [x for b in bands for x in [*b, *[0, -1] * ((width - len(b)) // 2)]]
    return (dim, _longs([r[0] for r in rows]), _longs([r[1] for r in rows]), _longs([r[2] for r in rows]),
            _longs(_matrix([r[3] for r in rows], dim)), _longs(flat))


def best_rows(values: np.ndarray, k: int):
    """(row, column, value) of the ``k`` greatest of each column above LEAST; of equal ones the first rows."""
    found = []
    values = values.copy()
    columns = np.arange(values.shape[1])
    for _ in range(min(k, len(values))):
        at = values.argmax(axis=0)
        value = values[at, columns]
        some = np.flatnonzero(value > LEAST)
        if not len(some):
            break
        found.append((at[some], some, value[some]))
        values[at[some], some] = LEAST
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def _search(k: int, positives: bool):
    """Pairs of blocks -> the best rows an anchor (and band) of the block."""
    names = ["row", "band", "vec_id", "score"]

    def run(batches):
        last, sums = None, None
        for batch in batches:
            for pair in batch.to_pylist():
                ids, labels, a_rows, a_ids, a_labels = (
                    np.frombuffer(pair[c], "<i8") for c in ("ids", "labels", "q_rows", "q_ids", "q_labels"))
                if last != pair["q_rows"]:
                    last, sums = pair["q_rows"], subset_sums(np.frombuffer(pair["matrix"], "<i8").reshape(len(a_ids), -1))
                bits = np.frombuffer(pair["bits"], np.uint8).reshape(pair["planes"], -1, len(ids))
                bands = np.frombuffer(pair["bands"], "<i8").reshape(len(a_ids), -1, 2)
                score = np.concatenate([scores(sums, bits[:, :, s:s + STRIP]) for s in range(0, len(ids), STRIP)])
                same = labels[:, None] == a_labels
                out = []
                if positives:
                    fits = same & (ids[:, None] != a_ids)
                    out = [(0, *best_rows(np.where(fits, score, LEAST), k))]
                else:
                    for b in range(bands.shape[1]):
                        fits = ~same & (ids[:, None] != a_ids) & (score >= bands[:, b, 0]) & (score <= bands[:, b, 1])
                        some = np.flatnonzero(fits.any(axis=0))
                        at, column, value = best_rows(np.where(fits[:, some], score[:, some], LEAST), k)
                        out.append((b, at, some[column], value))
                for b, at, column, value in out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a_rows[column]), pa.array(np.full(len(at), b, np.int32)), pa.array(ids[at]),
                         pa.array(value)], names)
    return run


FOUND = "row long, band int, vec_id long, score long"


def _met(candidates: DataFrame, anchors: DataFrame, k: int, positives: bool) -> DataFrame:
    """The ``k`` best rows of each anchor and band over all blocks, ranked from 1."""
    queries = materialize(anchors.mapInArrow(_blocks(ANCHORS, _queries, QUERIES), QUERIES), "anchors")
    queries = queries.withColumnsRenamed({"dim": "q_dim", "rows": "q_rows", "ids": "q_ids", "labels": "q_labels"})
    found = (candidates.hint("shuffle_replicate_nl").crossJoin(queries).filter("dim = q_dim")
             .mapInArrow(_search(k, positives), FOUND))
    rank = F.row_number().over(Window.partitionBy("row", "band").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def usable(vectors: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with integer components."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    finite = F.forall("embedding", lambda c: ~F.isnan(c))
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    # A null component makes the squared length null, an infinite one makes it too large.
    return rows.filter(F.col("label").isNotNull() & (square < F.lit(2.0 ** 62))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.col("x").cast("array<long>").alias("v"))


def hard_negatives(vectors: DataFrame, label: Column, every: int = 50, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) whose id is divisible by
    ``every`` and each of its best ``positives`` of the same ``label``: the best
    ``negatives`` of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    rows = materialize(usable(vectors, label, scale), "vectors")
    blocks = materialize(rows.mapInArrow(_blocks(BLOCK, _candidates, CANDIDATES), CANDIDATES), "candidates")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    best = materialize(_met(blocks, anchors, positives, True), "positives")
    # Whole numbers from low percent, rounded up, to high percent, rounded down, without overflow.
    whole, part = F.expr("score div 100"), F.expr("score % 100")
    least = whole * low - F.floor(-part * low / 100)
    most = whole * high + F.floor(part * high / 100)
    bands = best.groupBy("row").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", least.alias("least"), most.alias("most")))),
        lambda b: F.array(b["least"], b["most"]))).alias("bands"))  # ``positives`` of a row
    banded = anchors.join(bands, "row").select("row", "vec_id", "label", "v", "bands")
    found = _met(blocks, banded, negatives, False)
    pairs = best.select("row", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    own = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return (found.select("row", "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["row", "band"]).join(own, "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
