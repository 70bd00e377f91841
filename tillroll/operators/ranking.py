"""RANK() inside a partition (ties share a rank and leave a gap).

Two plans; full rankings take the second, rankings with ``top=`` the first,
unless ``method`` says otherwise:

* ``method="window"`` — ``rank().over(partitionBy(...))``: one shuffle by the
  partition key. With ``top=`` Spark inserts a partial WindowGroupLimit before
  the shuffle, so each task forwards at most ``top`` rows (plus ties) per
  partition value and a hot partition value cannot overload one task.

* ``method="range"`` — for a full ranking where one partition value may hold
  a large share of the rows. The rows are range-partitioned on
  (partition, order) so a hot value is split over many tasks, equal keys
  stay in one task, and each task ranks its slice locally. A row's rank is
  its local rank plus the number of rows of the same partition value in the
  earlier slices; those offsets come from a per-slice count table of at most
  (#slices + #partition values) rows. No task ever holds more than one slice.
  Slice bounds come from sampling, so the sliced rows are checkpointed (to
  the session's shared checkpoint folder) before the two passes that must
  agree on them: the local ranks and the per-slice counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import shared_dir


def rank_within(df: DataFrame, partition: Sequence[str], order: Sequence[Column],
                name: str = "rank", top: int | None = None, method: str | None = None,
                slices: int | None = None) -> DataFrame:
    method = method or ("range" if top is None else "window")
    if method == "window":
        w = Window.partitionBy(*partition).orderBy(*order)
        out = df.withColumn(name, F.rank().over(w))
        if top is not None:
            out = out.where(F.col(name) <= top)
        return out.withColumn(name, F.col(name).cast("bigint"))
    if method == "range":
        out = _range_rank(df, list(partition), list(order), name, slices)
        if top is not None:
            out = out.where(F.col(name) <= top)
        return out
    raise ValueError(f"unknown method {method!r}")


def bottom_within(df: DataFrame, partition: Sequence[str], metrics: Sequence[str], n: int,
                  name: str = "rank_from_bottom") -> DataFrame:
    """Tail sellers: rank by ``metrics`` ascending (NULLs last) and keep
    rank <= n, ties kept."""
    return rank_within(df, partition, [F.col(m).asc_nulls_last() for m in metrics], name=name, top=n)


def _range_rank(df: DataFrame, partition: list[str], order: list[Column], name: str,
                slices: int | None) -> DataFrame:
    spark = df.sparkSession
    keys = [F.col(p).asc_nulls_last() for p in partition] + order
    cols = df.columns
    shared_dir(spark)
    # Without an explicit count AQE sizes the slices (it merges neighbouring
    # ranges only, so slice ids stay in key order).
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    sliced = ranged.withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)

    local = sliced.withColumn(
        "_local", F.rank().over(Window.partitionBy("_slice", *partition).orderBy(*order)))
    counts = sliced.groupBy("_slice", *partition).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*partition).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col("_slice").alias("_o_slice"),
        *[F.col(p).alias(f"_o_{i}") for i, p in enumerate(partition)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))

    cond = [local["_slice"] == offsets["_o_slice"]] + [
        local[p].eqNullSafe(offsets[f"_o_{i}"]) for i, p in enumerate(partition)]
    joined = local.join(offsets, reduce(lambda a, b: a & b, cond))
    return joined.select(*[F.col(f"`{c}`") for c in cols],
                         (F.col("_offset") + F.col("_local")).cast("bigint").alias(name))
