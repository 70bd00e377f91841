"""Inputs stored in buckets, so that the star join's large sides are not shuffled.

``store_buckets`` writes lineitem and orders once as Spark tables that are bucketed
and sorted by the order key, with as many buckets each. Their join then reads
bucket k of one beside bucket k of the other: no exchange and no sort below it, in
this and every later build. An order holds a handful of lines, so no bucket is hot;
part and customer, whose keys can be hot, stay as they are and are joined by
shuffle, where adaptive execution splits a hot key.

A bucketed table needs a catalogue entry. ``bucketed_reader`` makes the entries
again from the folder alone (column names and types from the files, buckets from a
file beside them), so another application can read what one has written.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import file_system
from tillroll.sources.tables import read_table
from tillroll.sources.upkeep import Read

KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _table(root: str, name: str) -> str:
    return f"tillroll_{name}_{hashlib.sha1(root.rstrip('/').encode()).hexdigest()[:16]}"


def store_buckets(spark: SparkSession, sf_dir: str, root: str, buckets: int) -> None:
    """Write lineitem and orders of ``sf_dir`` under ``root`` in ``buckets`` buckets
    (about input bytes / 256 MB). One shuffle each; a task writes one bucket."""
    for name, key in KEYS.items():
        df = read_table(spark, sf_dir, name)
        (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .option("path", f"{root.rstrip('/')}/{name}").saveAsTable(_table(root, name)))
    fs, target = file_system(spark, f"{root.rstrip('/')}/buckets.json")
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps({"buckets": buckets}).encode()))
    stream.close()


def _define(spark: SparkSession, root: str, name: str, buckets: int) -> str:
    table, folder = _table(root, name), f"{root.rstrip('/')}/{name}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({KEYS[name]}) "
              f"SORTED BY ({KEYS[name]}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return table


def bucketed_reader(spark: SparkSession, sf_dir: str, root: str) -> Read:
    """A reader for ``sales.star_join``: lineitem and orders from their buckets, the rest from ``sf_dir``."""
    buckets = json.loads(spark.read.text(f"{root.rstrip('/')}/buckets.json", wholetext=True).first()[0])["buckets"]
    tables = {name: _define(spark, root, name, buckets) for name in KEYS}

    def read(name: str) -> DataFrame:
        return spark.table(tables[name]) if name in tables else read_table(spark, sf_dir, name)

    return read
