"""Bodies of files: text, markup and RTF by built-in expressions; PDF, Office files and UTF-16 by an Arrow helper."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileloom.functions import text
from fileloom.sources.listing import Store
from fileloom.sources.tables import cut

#: Extensions by the way their bodies are read.
PLAIN = (
    "txt md csv json log ini cfg toml yaml yml rs py js ts tsx jsx go java kt c h cpp cs rb php sh ps1 vue svelte sql jsonl"
).split()
MARKUP = ["html", "htm", "xml", "svg"]
OFFICE = ["docx", "xlsx", "pptx"]
EXTRACTABLE = [*PLAIN, *MARKUP, *OFFICE, "rtf", "pdf"]


def rtf_text(c: Column) -> Column:
    """Braces and control words (with the space after them) go, an escaped backslash stays."""
    return text.collapse_spaces(F.regexp_replace(c, r"\\(?:(\\)|[A-Za-z]* ?)|[{}]", "$1"))


#: A literal up to the first closing parenthesis or the end, and a backslash with the byte that it hides.
_LITERAL, _HIDDEN = re.compile(rb"\(((?:[^\\)]++|\\.)*+\\?)", re.DOTALL), re.compile(rb"\\(.)", re.DOTALL)
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\ufffd]")


def pdf_text(data: bytes) -> str:
    """Literals in parentheses, each up to the first closing one, then the printable characters of the whole file."""
    out = [" " + _HIDDEN.sub(rb"\1", m[1]).decode("latin-1") for m in _LITERAL.finditer(data)]
    runs = _CONTROL.sub("", data.decode("utf-8", "replace"))
    return " ".join(("".join(out) + " " + runs).split())


def _wanted(ext: str, part: str) -> bool:
    if ext == "docx":
        return part == "word/document.xml" or part.endswith("/document.xml")
    if ext == "xlsx":
        return "sharedStrings" in part or "/worksheets/sheet" in part
    return "/slides/slide" in part and part.endswith(".xml")


def office_text(ext: str, data: bytes) -> str | None:
    """Parts in the archive's order, each after a space; None if the archive or a part can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            parts = [archive.read(i).decode("utf-8") for i in archive.infolist() if _wanted(ext, i.filename.replace("\\", "/"))]
    except (zipfile.BadZipFile, UnicodeDecodeError, NotImplementedError, RuntimeError, EOFError, ValueError, OSError):
        return None
    return "".join(" " + text.markup_text(p) for p in parts)


def utf16_text(data: bytes) -> str:
    """By its mark; a half unit at the end is left out, lone surrogates are replaced."""
    order = "utf-16-le" if data[:2] == b"\xff\xfe" else "utf-16-be"
    return data[2 : 2 + (len(data) - 2) // 2 * 2].decode(order, "replace")


#: Characters of bodies that a worker holds as Python values at once, but for a larger body.
PIECE_BYTES = 1 << 20


def _body(ext: str, data: bytes) -> str | None:
    if ext == "pdf":
        return pdf_text(data)
    return office_text(ext, data) if ext in OFFICE else utf16_text(data)


def bodies_in_pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bodies of batches (ext, content), null for null. Values are taken from a batch one by one and handed back in
    pieces, so that a worker holds no more than a piece beside the batch."""
    for exts, contents in batches:
        out, size = [], 0
        for ext, data in zip(exts, contents, strict=True):
            out.append(_body(ext.as_py(), data.as_py()) if data.is_valid else None)
            size += len(out[-1] or "")
            if size >= PIECE_BYTES:
                yield pa.array(out, pa.string())
                out, size = [], 0
        yield pa.array(out, pa.string())


def _by_helper(kind: Column, content: Column) -> Column:
    @F.arrow_udf("string")
    def helper(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from bodies_in_pieces(batches)

    # Else the filter on bodies is pushed below, and every file is read twice by twice the workers.
    return helper.asNondeterministic()(kind, content)


def extract_bodies(files: DataFrame) -> DataFrame:
    """path, body for files(path, ext, content). Files that can't be read have no row: bytes that are not UTF-8, broken
    archives, other extensions. A mark at the start is honoured in plain text alone."""
    kind, content = F.col("ext"), F.col("content")
    plain = kind.isin(PLAIN)
    mark = F.hex(F.substring(content, 1, 2))
    wide = plain & mark.isin("FFFE", "FEFF")
    skip = F.when(plain & (F.hex(F.substring(content, 1, 3)) == "EFBBBF"), 4).otherwise(1)
    as_text = content.substr(skip, F.octet_length(content)).cast("string")
    as_text = F.when(F.is_valid_utf8(as_text), as_text)
    helped = kind.isin([*OFFICE, "pdf"]) | wide
    # The helper gets a null for every row that it has nothing to do with.
    by_helper = _by_helper(kind, F.when(helped, content))
    markup = kind.isin(MARKUP)
    rows = files.where(kind.isin(EXTRACTABLE)).select("path", "ext", as_text.alias("_text"), by_helper.alias("_helped"), helped.alias("_by"))
    rows = text.with_markup_text(rows.withColumn("_markup", F.when(markup, F.col("_text"))), "_markup", "_plain")
    body = F.when(F.col("_by"), F.col("_helped")).when(markup, F.col("_plain"))
    body = body.when(kind == "rtf", rtf_text(F.col("_text"))).otherwise(F.col("_text"))
    return rows.select("path", body.alias("body")).where(F.col("body").isNotNull())


#: Bytes of files that go into one Arrow batch; a larger file is alone in its batch. Bytes that a task reads about, and
#: that opening a file counts as.
BATCH_BYTES, TASK_BYTES, OPEN_BYTES = 8 << 20, 128 << 20, 64 << 10


def by_even_bytes(gated: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, ext of gated(path, ext, size), dealt out so that each task has about as many bytes to read as any other: the
    order of paths is cut where the sums of sizes pass a task's share. tasks: as many as TASK_BYTES make, and at least
    one a core. Sums run within ranges of paths and over the ranges' totals, so nothing but a row per range is in one
    place, and what is shuffled is paths."""
    context = gated.sparkSession.sparkContext
    rows = gated.select("path", "ext", (F.col("size") + OPEN_BYTES).alias("_cost"))
    rows = cut(rows.repartitionByRange("path").withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.sum("_cost").alias("_sum"))
    total = sums.agg(F.sum("_sum")).first()[0] or 1
    tasks = tasks or max(context.defaultParallelism, -(-total // TASK_BYTES))
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_cost").over(within), F.lit(0))
    rows = rows.withColumn("_before", before).join(F.broadcast(starts), "_part")
    # The middle of a file decides: a large one is not put on top of a full share.
    share = ((F.col("_start") + F.col("_before") + F.col("_cost") / 2) * tasks / F.lit(total)).cast("int")
    return rows.select("path", "ext", F.least(share, F.lit(tasks - 1)).alias("_task")).repartitionById(tasks, "_task").select("path", "ext")


def _read(gated: DataFrame, opener: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """path, ext, content of gated rows, read where they are dealt to; those that can't be read are left out."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "ext", "content"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        content, rows, size = opener(), [], 0
        for path, ext in (pair for f in frames for pair in zip(f["path"], f["ext"], strict=True)):
            try:
                rows.append((path, ext, content(path)))
            except OSError:
                continue
            size += len(rows[-1][2])
            if size >= BATCH_BYTES:
                yield frame(rows)
                rows, size = [], 0
        yield frame(rows)

    return by_even_bytes(gated).mapInPandas(read, "path string, ext string, content binary")


def _mounted(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def read_files(spark: SparkSession, gated: DataFrame) -> DataFrame:
    """path, ext, content of gated catalog rows, read by the executors from a mount that all of them have."""
    return _read(gated, lambda: _mounted)


def read_store(spark: SparkSession, gated: DataFrame, root: str) -> DataFrame:
    """read_files for paths below a root in a store (listing.list_store). Only files of gated rows are opened."""

    def opener() -> Callable[[str], bytes]:
        store = Store(root)

        def content(path: str) -> bytes:
            with store.system.open_input_stream(store.own(path)) as f:
                return f.read()

        return content

    return _read(gated, opener)
