"""Intermediate tables in the folder that the cluster shares.

Operators that read an intermediate result more than once write it as Parquet
under ``spark.checkpoint.dir`` (through ``session.shared_dir``) and read it
back: lineage ends there, a lost executor costs a re-read, and nothing lies on
a machine-local disk. The folders of one process are removed when it exits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import file_system, remove_at_exit, shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed at the end of the process."""
    path = f"{shared_dir(spark)}/tillroll-llm-{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def materialize(df: DataFrame, name: str, rows: int | None = None, per_task: int = 200_000,
                part: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.
    ``rows``, a bound on its rows where one is known, keeps a small table from
    being written by more tasks than one for every ``per_task`` rows. A column
    ``part`` of few values lays the rows out in a folder for each, so that a filter
    on it reads no others; tasks keep a writer open for each, without a sort."""
    path, spark = scratch_path(df.sparkSession, name), df.sparkSession
    if part:
        before = spark.conf.get(WRITERS)
        spark.conf.set(WRITERS, 16)
        try:
            df.write.partitionBy(part).parquet(path)
        finally:
            spark.conf.set(WRITERS, before)
        return spark.read.schema(df.schema).parquet(path)
    if rows is not None:
        tasks = 1 + rows // per_task
        if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_BITS = 1 << 27  # 16 MB broadcast; more keys are sifted less well


def sift(df: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """``df`` without most rows whose ``column`` is not in that of ``keys`` (about ``n``
    rows), so that the exact join that has to follow shuffles few others: a bitmap of 16
    bits a key, in pieces of 2^15 bits, goes to every task."""
    bits = min(max(1 << 15, 1 << (16 * n).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    maps = (keys.select(place.alias("_place")).groupBy(F.shiftright("_place", 15).alias("_piece"))
            .agg(F.bitmap_construct_agg(F.col("_place").bitwiseAND(F.lit((1 << 15) - 1))).alias("_map")))
    byte = F.expr("cast(conv(hex(substring(_map, cast(shiftright(_place & 32767, 3) as int) + 1, 1)), 16, 10) as int)")
    return (df.withColumn("_place", place)
            .join(F.broadcast(maps), F.shiftright("_place", 15) == F.col("_piece"))
            .filter(F.getbit(byte, F.col("_place").bitwiseAND(F.lit(7)).cast("int")) == 1).select(*df.columns))


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` (without ``part``) that a later one has replaced and nothing reads again."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            fs, target = file_system(df.sparkSession, path)
            fs.delete(target, True)
