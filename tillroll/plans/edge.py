"""The report edge: exact values become DOUBLE only in the last projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def report_edge(df: DataFrame) -> DataFrame:
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            c = c.cast("double").alias(field.name)
        cols.append(c)
    return df.select(*cols)
