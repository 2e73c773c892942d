"""Columns derived from a file's name and path. All are built-in expressions; `with_derived` computes them once, so that
they can be stored and filters on them pushed down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileloom import schema

#: Extensions with a picture or page preview.
PREVIEW = "pdf docx xlsx pptx png jpg jpeg gif bmp".split()
_HAS_EXT = r"(?s)\A.+\.[^.]*\z"
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_UPPER.lower())


def last_component(path: Column) -> Column:
    """The name in a path; trailing separators do not count."""
    return F.regexp_extract(path, r"([^\\/]+)[\\/]*\z", 1)


def extension(path: Column) -> Column:
    """After the last dot of the path's last component, A-Z lowered; null without a dot or if it is the first
    character alone; `..` has none."""
    name = last_component(path)
    return F.when(name.rlike(_HAS_EXT) & (name != ".."), ascii_lower(F.substring_index(name, ".", -1)))


def stem(name: Column) -> Column:
    """D3: the name up to its last dot; a name that begins with its only dot is its own stem."""
    return F.when(name.rlike(_HAS_EXT) & (name != ".."), F.regexp_extract(name, r"(?s)\A(.+)\.[^.]*\z", 1)).otherwise(name)


def extension_length(name: Column) -> Column:
    """Characters after the last dot of the name, 0 without one. `.gitignore` has 9 although it has no extension."""
    return F.when(F.contains(name, F.lit(".")), F.length(F.substring_index(name, ".", -1))).otherwise(0)


def depth(path: Column) -> Column:
    """Components without a drive or share; `.` does not count, `..` does."""
    local = F.regexp_replace(path, r"\A(?:[A-Za-z]:|[\\/]{2}[^\\/]+[\\/]+[^\\/]+)", "")
    return F.size(F.filter(F.split(local, r"[\\/]+"), lambda p: (p != "") & (p != ".")))


def normal_path(path: Column) -> Column:
    """One backslash between components, lower case, none at the end."""
    joined = F.regexp_replace(F.translate(path, "/", "\\"), r"\\+", r"\\")
    return F.lower(F.regexp_replace(joined, r"(?<=.)\\\z", ""))


def normal_text(path: str) -> str:
    """normal_path of an argument."""
    out = ""
    for c in path.replace("/", "\\"):
        if not (c == "\\" and out.endswith("\\")):
            out += c.lower()
    return out[:-1] if len(out) > 1 and out.endswith("\\") else out


def parent_of(path_norm: Column) -> Column:
    """The normal path's parent; null for a root."""
    return F.when(path_norm.rlike(r"(?s)\A.*\\[^\\]+\z"), F.regexp_extract(path_norm, r"(?s)\A(.*)\\[^\\]+\z", 1))


def effective_attributes(attributes: Column, is_dir: Column) -> Column:
    """Directories have the directory bit."""
    return F.when(is_dir, attributes.bitwiseOR(schema.DIRECTORY)).otherwise(attributes)


def wants_preview(ext: Column, snippet: Column) -> Column:
    """A hit without a snippet, of a kind that can be shown as a picture."""
    return snippet.isNull() & F.coalesce(ext.isin(PREVIEW), F.lit(False))


def filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 to a timestamp; what lies before 1970 is 1970."""
    micros = F.call_function("div", ticks - F.expr("116444736000000000L"), F.expr("10L"))  # whole numbers throughout
    return F.timestamp_micros(F.greatest(F.expr("0L"), micros))


def with_derived(catalog: DataFrame) -> DataFrame:
    """catalog with ext, stem, ext_len, name_len, depth, path_norm, parent_norm, eff_attributes."""
    found = catalog.withColumns(
        {
            "ext": extension(F.col("path")),
            "stem": stem(F.col("name")),
            "ext_len": extension_length(F.col("name")),
            "name_len": F.length("name"),
            "depth": depth(F.col("path")),
            "path_norm": normal_path(F.col("path")),
            "eff_attributes": effective_attributes(F.col("attributes"), F.col("is_dir")),
        }
    )
    return found.withColumn("parent_norm", parent_of(F.col("path_norm")))
