"""Report sinks.

``write_report`` writes a folder of parts, by the executors in parallel (one file
per task). ``export_report`` writes the one CSV file that the study exports per
result: the executors write the lines as text parts without a header, in the order
of the result's global sort (range-partitioned, so no task sorts everything), and
the parts are put together behind a header line, by the file system's own
``concat`` where it has one, else by copying bytes from stream to stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType, StructType

from tillroll.plans.edge import report_edge
from tillroll.session import file_system

NULL_MARK = "\\N"


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 exact: bool = True) -> None:
    """CSV (header, text quoted, LF line ends, UTF-8 without BOM, ``\\N`` for
    NULL, an empty field for empty text, blanks kept) or parquet. Money and ratios are written as
    exact decimals with their scale ("3.50", "5.846"); ``exact=False`` writes
    them as DOUBLE."""
    out = df if exact else report_edge(df)
    writer = out.write.mode(mode)
    if fmt == "csv":
        (writer.option("header", True).option("quoteAll", True).option("lineSep", "\n")
         .option("emptyValue", "").option("nullValue", NULL_MARK)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a CSV report back with an explicit schema (no inference); the mark
    of ``write_report`` is NULL, an empty field is empty text, and text is not
    trimmed."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("nullValue", NULL_MARK).option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _line(schema: StructType) -> Column:
    """A row as a CSV line: whole numbers of up to 32 bits bare, everything else
    quoted, quotes doubled; NULL is an empty quoted field (an empty bare one among those numbers)."""
    fields = []
    for f in schema.fields:
        text = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))
        if not isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(text)
    return F.concat_ws(",", *fields)


def export_report(df: DataFrame, path: str) -> None:
    """One CSV file at ``path`` (replaced if there): a header line of quoted
    names, then the rows in the order of ``df``, LF line ends, UTF-8. Text
    with line breaks stays inside its quotes. The file appears whole or not at all."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = file_system(spark, path)
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    _, folder = file_system(spark, draft)
    try:
        df.select(_line(df.schema).alias("value")).write.option("lineSep", "\n").text(f"{draft}/rows")
        _, whole = file_system(spark, f"{draft}/whole")
        header = bytearray((",".join(map(_quoted, df.columns)) + "\n").encode())
        stream = fs.create(whole)
        stream.write(header)
        stream.close()
        parts = sorted((s for s in fs.listStatus(file_system(spark, f"{draft}/rows")[1])
                        if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
        try:
            paths = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
            for k, s in enumerate(parts):
                paths[k] = s.getPath()
            if parts:
                fs.concat(whole, paths)
        except Exception as error:
            if "UnsupportedOperation" not in f"{type(error).__name__} {error}":
                raise
            stream = fs.create(whole, True)
            stream.write(header)
            for s in parts:
                part = fs.open(s.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, conf, False)
                part.close()
            stream.close()
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(whole, target):
            raise OSError(f"could not rename to {path}")
    finally:
        fs.delete(folder, True)
