"""Metadata filters: each is one condition on stored or derived columns of the catalog, all are ANDed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileloom.functions import derive
from fileloom.operators.query import Compare, Query


def compare(c: Column, by: Compare) -> Column:
    v = F.lit(by.value)
    return {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "=": c == v}[by.op]


def conditions(q: Query) -> list[Column]:
    """Conditions on a catalog with derived columns."""
    col, found = F.col, []
    if q.files_only:
        found.append(~col("is_dir"))
    if q.folders_only:
        found.append(col("is_dir"))
    if q.all_bits:
        found.append(col("eff_attributes").bitwiseAND(q.all_bits) == q.all_bits)
    if q.any_bits:
        found.append(col("eff_attributes").bitwiseAND(q.any_bits) != 0)
    if q.no_ext:
        found.append(~col("is_dir") & col("ext").isNull())
    if q.dotfile:
        found.append(col("name").startswith("."))
    if q.extensions:
        found.append(~col("is_dir") & F.coalesce(col("ext"), F.lit("")).isin(q.extensions))
    found += [
        compare(col(name), by)
        for name, by in (("size", q.size), ("name_len", q.name_len), ("ext_len", q.ext_len), ("depth", q.depth))
        if by is not None
    ]
    if q.after is not None:
        found.append(col("modified") >= F.lit(q.after))
    if q.before is not None:
        found.append(col("modified") < F.lit(q.before))
    if q.parent is not None:
        found.append(F.coalesce(col("parent_norm") == derive.normal_text(q.parent), F.lit(False)))
    if q.path_contains is not None:
        found.append(col("path_norm").contains(derive.normal_text(q.path_contains)))
    if q.root is not None:
        found.append(col("path_norm").startswith(derive.normal_text(q.root)))
    return found


def filter_condition(q: Query) -> Column:
    return reduce(and_, conditions(q), F.lit(True))
