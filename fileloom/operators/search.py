"""The search itself: filters, matching, score, order, limit, snippets."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.functions import derive, text
from fileloom.operators import filters, match, rank
from fileloom.operators.query import Query
from fileloom.schema import CATALOG, SNIPPET
from fileloom.sources.tables import cut

#: Candidates whose paths may be broadcast to the bodies, and their bytes; hits whose paths go into one condition.
FEW_PATHS, FEW_BYTES, FEW_HITS = 500_000, 64 << 20, 1000
HIT_COLUMNS = [*CATALOG.names, "score", "name_match", "path_match", "content_match", "snippet"]


def candidates(catalog: DataFrame, q: Query, narrowing: bool = True) -> DataFrame:
    """Catalog rows with derived columns that pass the metadata filters, before any body is read. A catalog that has the
    derived columns stored is used as it is, so that the filters reach its files."""
    rows = catalog if "path_norm" in catalog.columns else derive.with_derived(catalog)
    rows = rows.where(filters.filter_condition(q))
    prefix = match.narrowing_prefix(q) if narrowing else None
    return rows.where(match.names_with_prefix(F.col("name"), prefix)) if prefix is not None else rows


def body_flags(bodies: DataFrame, q: Query, snippets: bool, by_bytes: bool = False, key: str = "path") -> DataFrame:
    """key, a flag for each atom (_a0, ...) and each excluded pattern (_x0, ...) that a body can decide, and with snippets
    the snippet, of the bodies that have any of these: all that a search needs of a body, from the bodies' own scan."""
    body = match.Field(F.col("body"), F.col("_low"))
    flags = {f"_a{k}": match.in_body(atom, body, q) for k, atom in enumerate(q.must)}
    flags |= {f"_x{k}": match.in_body((p,), body, q) for k, p in enumerate(q.must_not) if not match.only_names(p)}
    flags = flags if q.needs_body else {}
    # One lower-casing of a body for all patterns.
    rows = bodies.select(key, "body", F.lower("body").alias("_low")).withColumns(flags).drop("_low")
    if snippets:
        rows = text.with_snippet(rows, q.terms, by_bytes)
        return rows.where(reduce(or_, map(F.col, flags), F.col("snippet").isNotNull()))
    return rows.drop("body").where(reduce(or_, map(F.col, flags), F.lit(False)))


def _of_candidates(bodies: DataFrame, rows: DataFrame, q: Query, key: str) -> DataFrame:
    """Bodies of the candidates alone, if filters leave so few of these that their paths can be broadcast."""
    if not filters.conditions(q):
        return bodies
    paths = rows.select(key)
    n, size = paths.limit(FEW_PATHS + 1).agg(F.count("*"), F.sum(F.octet_length(key))).first()
    return bodies.join(F.broadcast(paths), key, "left_semi") if n <= FEW_PATHS and (size or 0) <= FEW_BYTES else bodies


def matched(
    rows: DataFrame, bodies: DataFrame | None, q: Query, snippets: bool = True, by_bytes: bool = False, key: str = "path"
) -> DataFrame:
    """Rows that match, with the match flags, and with snippets if wanted. Bodies take part only if they can decide a
    match or give a snippet; what is joined to the rows is flags, never a body."""
    no, flags = F.lit(False), []
    if bodies is not None and (q.needs_body or snippets):
        found = body_flags(_of_candidates(bodies, rows, q, key), q, snippets, by_bytes, key)
        flags = [c for c in found.columns if c.startswith("_")]
        rows = rows.join(found, key, "left")
    of_body = lambda c: F.coalesce(F.col(c), no) if c in flags else no
    name, path = (match.Field(F.col(c), F.lower(c)) for c in ("name", "path"))
    for k, p in enumerate(q.must_not):
        rows = rows.where(~match.excluded(p, name, path, of_body(f"_x{k}"), q))
    found = [match.atom_matches(atom, name, path, of_body(f"_a{k}"), q) for k, atom in enumerate(q.must)]
    for n, p, b in found:
        rows = rows.where(n | p | b)
    named = {
        flag: match.every([f[i] for f in found]) if found else no
        for i, flag in enumerate(("name_match", "path_match", "content_match"))
    }
    return rows.withColumns(named).drop(*flags)


def search(
    catalog: DataFrame,
    bodies: DataFrame | None,
    q: Query,
    now: datetime,
    narrowing: bool = True,
    snippets: bool = True,
    by_bytes: bool = False,
    key: str = "path",
) -> DataFrame:
    """HIT_COLUMNS of the hits in order. key: the column by which catalog rows have bodies. narrowing: as match.narrowing_prefix says; without, `n:` looks anywhere in
    names. Another order than by score leaves the score 0.

    With a limit the hits are found at once, and snippets are cut from the bodies of these alone; without one, snippets
    are cut where the bodies are matched."""
    wants = snippets and bodies is not None and any(q.terms)
    hits = matched(candidates(catalog, q, narrowing), bodies, q, wants and q.limit is None, by_bytes, key)
    hits = hits.withColumn("score", rank.score(q, now) if q.sort == "score" else F.lit(0.0))
    columns = [c for c in HIT_COLUMNS if c in hits.columns]
    if wants and q.limit is not None:
        hits = cut(rank.ordered(hits.select(*dict.fromkeys([*columns, key])), q))
        if q.limit <= FEW_HITS:
            theirs = bodies.where(F.col(key).isin([r[0] for r in hits.select(key).collect()]))  # reaches the files
        else:
            theirs = bodies.join(hits.select(key).distinct(), key, "left_semi")
        theirs = text.with_snippet(theirs.select(key, "body"), q.terms, by_bytes)
        hits = rank.ordered(hits.join(theirs, key, "left"), q)
    else:
        hits = rank.ordered(hits.select(*columns), q)
    if "snippet" not in hits.columns:
        hits = hits.withColumn("snippet", F.lit(None).cast(SNIPPET))
    return hits.select(*HIT_COLUMNS)
