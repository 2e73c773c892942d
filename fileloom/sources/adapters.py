"""The test tables as a catalog, bodies and change logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.functions.text import PIECE_ROWS
from fileloom.schema import CATALOG, CHANGES
from fileloom.sources.tables import table

#: "Now" of all queries over the test tables.
NOW = datetime(2024, 1, 31)
KINDS = ["txt", "md", "html", "pdf", "docx", "csv", "log", "jpeg"]
_NOW_SQL = "timestamp'2024-01-31 00:00:00'"
_NAME = """
CASE WHEN doc_id % 50 = 0 THEN concat('.dot-', doc_id) WHEN doc_id % 49 = 0 THEN concat('README-', doc_id)
ELSE concat(lang, '-', source, '-', doc_id, '.', element_at(array('txt','md','html','pdf','docx','csv','log','jpeg'), cast(doc_id % 8 as int) + 1)) END
"""


def files(docs: DataFrame) -> DataFrame:
    rows = docs.withColumn("name", F.expr(_NAME))
    return rows.select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("long").alias("parent_id"),
        "name",
        F.expr(r"concat(r'C:\docs\', lang, r'\', source, r'\', name)").alias("path"),
        F.expr("if(doc_id % 97 = 0, 0L, n_chars)").alias("size"),
        F.expr(f"{_NOW_SQL} - make_dt_interval(0, 0, cast(doc_id * 37 as int), 0)").alias("modified"),
        F.lit(False).alias("is_dir"),
        F.expr("if(doc_id % 7 = 0, 1, 0) + if(doc_id % 11 = 0, 2, 0) + if(doc_id % 13 = 0, 4, 0)").alias("attributes"),
    )


def directories(docs: DataFrame) -> DataFrame:
    paths = docs.select(F.expr(r"concat(r'C:\docs\', lang)").alias("path"))
    paths = paths.union(docs.select(F.expr(r"concat(r'C:\docs\', lang, r'\', source)"))).distinct()
    # Few rows: languages and sources.
    return paths.select(
        F.expr("10000000L + row_number() over (order by path)").alias("id"),
        F.lit(None).cast("long").alias("parent_id"),
        F.expr(r"substring_index(path, r'\', -1)").alias("name"),
        "path",
        F.expr("0L").alias("size"),
        F.expr("timestamp'1970-01-01 00:00:00'").alias("modified"),
        F.lit(True).alias("is_dir"),
        F.lit(16).alias("attributes"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return files(docs).unionByName(directories(docs)).select(*CATALOG.names)


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("name", F.expr(_NAME))
    return docs.select(F.expr(r"concat(r'C:\docs\', lang, r'\', source, r'\', name)").alias("path"), F.col("text").alias("body"))


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    kind = F.expr(
        "CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'create' WHEN 'click' THEN 'rename' "
        "WHEN 'error' THEN 'delete' END"
    )
    rows = events.withColumn("kind", kind).where(F.col("kind").isNotNull())
    name = F.expr("concat(user_id, '-', event_id, '.txt')")
    columns = {
        "seq": F.col("event_id"), "kind": F.col("kind"), "id": F.col("user_id"), "parent_id": F.lit(None), "name": name,
        "path": F.concat(F.lit("C:\\u\\"), name), "size": F.lit(0), "modified": F.col("ts"), "is_dir": F.lit(False),
        "attributes": F.lit(0),
    }
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CHANGES.fields])


_PARTS = {"docx": "word/document.xml", "xlsx": "xl/sharedStrings.xml", "pptx": "ppt/slides/slide1.xml"}


def office_files(rows: DataFrame) -> DataFrame:
    """path, ext, content of rows(path, ext, text): each text as the main part of an archive, with a part beside it that
    holds none of the document's text."""

    def packed(ext: str, text: str) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("docProps/app.xml", "<Properties>none</Properties>")
            archive.writestr(_PARTS[ext], f"<?xml version='1.0'?><r><t>{escape(text, quote=False)}</t></r>")
        return data.getvalue()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                paths, exts, texts = batch.slice(at, PIECE_ROWS).columns
                contents = [packed(ext.as_py(), text.as_py()) for ext, text in zip(exts, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([paths, exts, pa.array(contents, pa.binary())], names=["path", "ext", "content"])

    return rows.select("path", "ext", "text").mapInArrow(pack, "path string, ext string, content binary")
