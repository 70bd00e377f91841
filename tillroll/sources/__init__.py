"""Inputs and outputs: the driver's parquet tables (``tables``), the wide sales
table and event lines (``sales``), and report writers and readers (``sinks``)."""
