"""Exact top-k inner products by no-random-access aggregation.

Vectors are packed into blocks. In a block, every dimension is a list of its
rows sorted by component, read from the top for a query whose weight there is
positive and from the bottom for a negative one. The lists are read in depth
steps, all at once. A row's lower bound adds what was read of it to the worst
value of each list not yet read for it, the upper bound to the value at which
each list stands. Reading stops for a query when at most a few rows of the
block could still reach its k-th best lower bound; the final scores of those
rows alone are then resolved in 64-bit integers. Bounds are sums of integers below
2^53 (beyond, they get a slack), so the result is exact. The k-th best score that a task has found for a query so far is a
lower bound for its next blocks.

The query set meets the candidates block by block (blocks of queries against
blocks of candidates, nothing else is crossed); each task keeps k rows per
query, and a window per query keeps the best k of those.

Defined cases: vectors that are null or empty or hold null or non-finite
components, rows with a null id, and vectors whose squared length in those integers
reaches 2^62 (their scores might not fit a long) take no part; a query meets only vectors
of its own length; rows that repeat an id are vectors of their own, and none
of them is a candidate for its own id's queries; fewer candidates than k: all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.store import materialize

BLOCK = 4096
QUERY_BLOCK = 512
STEPS = (0.25, 0.5, 0.75, 1.0)
FEW = 16
EXACT = 2 ** 53  # float64 sums of integers are exact below; above, bounds get slack
LARGEST = 2.0 ** 62  # squared length from which a score might not fit a long


def _pack(limit: int):
    """(vec_id, vector of integers) -> one row per block."""
    def run(batches):
        waiting: dict[int, list] = {}

        def block(dim, rows):
            return pa.RecordBatch.from_pylist([{
                "dim": dim, "ids": np.array([r[0] for r in rows], "<i8").tobytes(),
                "matrix": np.array([r[1] for r in rows], "<i8").tobytes()}],
                schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())]))

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = vector.values.to_numpy(zero_copy_only=False)
                rows = waiting.setdefault(len(v), [])
                rows.append((vec_id, v))
                if len(rows) == limit:
                    yield block(len(v), rows)
                    waiting[len(v)] = []
        for dim, rows in waiting.items():
            if rows:
                yield block(dim, rows)
    return run


class Lists:
    """A candidate block's sorted lists: per dimension the sorted components
    and each row's rank from the top and from the bottom."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole
        self.x = x = whole.astype(np.float64)
        n = len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.low = np.empty(x.shape, np.int32)
        np.put_along_axis(self.low, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], x.shape), axis=0)
        self.high = n - 1 - self.low

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all rows' scores once every list is read to ``depth``."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        top, bottom = self.high < depth, self.low < depth
        read = up @ (self.x * top).T + down @ (self.x * bottom).T
        if depth >= len(self.x):
            return read, read
        stand_top, stand_bottom = self.sorted[-depth], self.sorted[depth - 1]
        unread_top, unread_bottom = ~top, ~bottom
        weight = np.concatenate([up * stand_top, down * stand_bottom], axis=1)
        worst = np.concatenate([up * self.sorted[0], down * self.sorted[-1]], axis=1)
        unread = np.concatenate([unread_top, unread_bottom], axis=1).T.astype(np.float64)
        return read + worst @ unread, read + weight @ unread


def search_block(lists: Lists, query_ids: np.ndarray, whole: np.ndarray, k: int, floor: np.ndarray):
    """(query position, candidate row, score) that may belong to the top k:
    no-random-access aggregation over one block. ``floor``: a score per query
    that k rows are already known to reach."""
    n, q = len(lists.x), whole.astype(np.float64)
    largest = np.abs(q).max(initial=0) * np.abs(lists.x).max(initial=0) * q.shape[1]
    slack = largest * 2.0 ** -40 if largest >= EXACT else 0.0
    todo = np.arange(len(q))
    found = []
    for share in STEPS:
        depth = max(1, min(n, int(np.ceil(share * n))))
        low, high = lists.bounds(q[todo], depth)
        own = query_ids[todo][:, None] == lists.ids[None, :]
        low[own], high[own] = -np.inf, -np.inf
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
        kth = np.maximum(kth, floor[todo])
        alive = (high >= kth[:, None] - slack) & ~own
        settled = (alive.sum(axis=1) <= max(FEW, k)) | (depth >= n)
        rows, cols = np.nonzero(alive & settled[:, None])
        if len(rows):
            at = todo[rows]
            found.append((at, cols, np.einsum("ij,ij->i", whole[at], lists.whole[cols])))
        todo = todo[~settled]
        if not len(todo):
            break
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


HITS = "query_row long, query_id long, vec_id long, score long"


def _best(at, ids, score, k):
    """The k best per query position: largest score, then smallest id."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[nth < k], ids[nth < k], score[nth < k]


def _search(k: int):
    def run(batches):
        best: dict[int, tuple] = {}  # per block of queries: positions, ids, scores, query ids
        last, lists = None, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("chunk", "q_ids", "q_matrix", "ids", "matrix", "dim")),
                           strict=True):
                chunk, q_ids, q, ids, x, dim = (v.as_py() for v in row)
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                q = np.frombuffer(q, "<i8").reshape(-1, dim)
                if last != (ids.tobytes(), x):
                    last, lists = (ids.tobytes(), x), Lists(ids, np.frombuffer(x, "<i8").reshape(-1, dim))
                at, vec, score, _ = best.get(chunk, (np.zeros(0, int), np.zeros(0, np.int64),
                                                     np.zeros(0, np.int64), q_ids))
                floor = np.full(len(q), -np.inf)
                full = np.bincount(at, minlength=len(q)) >= k
                if full.any():
                    least = np.full(len(q), np.inf)
                    np.minimum.at(least, at, score)
                    floor[full] = least[full]
                new_at, cols, new = search_block(lists, q_ids, q, k, floor)
                merged = _best(np.concatenate([at, new_at]), np.concatenate([vec, ids[cols]]),
                               np.concatenate([score, new]), k)
                best[chunk] = (*merged, q_ids)
        for chunk, (at, vec, score, q_ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk * QUERY_BLOCK + at), pa.array(q_ids[at]), pa.array(vec),
                 pa.array(score)], ["query_row", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) whose id is divisible by
    ``every``: the ``k`` highest inner products of floor(scale * component)
    with all other rows; ties go to the smaller vec_id."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    usable = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    usable = usable.filter(square < LARGEST)
    packed = "dim int, ids binary, matrix binary"
    blocks = materialize(usable.mapInArrow(_pack(BLOCK), packed), "blocks")
    queries = (usable.filter(F.col("vec_id") % every == 0).mapInArrow(_pack(QUERY_BLOCK), packed)
               .select(F.monotonically_increasing_id().alias("chunk"), F.col("dim").alias("q_dim"),
                       F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")))
    queries = materialize(queries, "queries")
    met = (blocks.hint("shuffle_replicate_nl").crossJoin(queries).filter("dim = q_dim")
           .mapInArrow(_search(k), HITS))
    rank = F.row_number().over(Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
