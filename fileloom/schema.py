"""Schemas of the tables that the jobs read and write, and attribute bits."""

from __future__ import annotations

from pyspark.sql import types as T

#: Attribute bits.
READONLY, HIDDEN, SYSTEM, DIRECTORY = 1, 2, 4, 16
ATTRIBUTE_LETTERS = {"R": READONLY, "H": HIDDEN, "S": SYSTEM, "D": DIRECTORY}

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("parent_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("attributes", T.IntegerType()),
    ]
)
BODIES = T.StructType([T.StructField("path", T.StringType()), T.StructField("body", T.StringType())])
CHANGES = T.StructType(
    [T.StructField("seq", T.LongType(), False), T.StructField("kind", T.StringType()), *CATALOG.fields]
)
USN = "seq long, file_id long, parent_id long, reason long, filename string, path string, size long, modified timestamp, is_dir boolean"
WATCHER = "seq long, kind string, path string, new_path string, is_dir boolean, size long, modified timestamp"
NODES = "id long, parent long, name string, is_dir boolean, filetime long, attributes int"
SNIPPET = "struct<text:string,highlights:array<struct<start:int,end:int>>>"
