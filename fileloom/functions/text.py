"""Text functions: markup to text, white space, words, snippets and highlights. Built-in expressions; the rows that they
can't treat exactly go through Arrow helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileloom import schema

CONTEXT = 80
#: Rows that a worker turns into Python values at once.
PIECE_ROWS = 256
#: The entities that are known by name.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ODD_MARKUP = r"&(?![A-Za-z]+;)"


def collapse_spaces(c: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def simple_markup_text(c: Column) -> Column:
    """X1 for markup whose only entities have names: tags become a space, script and style text stays."""
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>?", " "), ">", "")
    for name in ("lt", "gt", "quot", "apos", "nbsp"):
        c = F.regexp_replace(c, f"&{name};", ENTITIES[name])
    c = F.regexp_replace(F.regexp_replace(c, r"&(?!amp;)[^&;]*;", ""), "&amp;", "&")
    return collapse_spaces(c)


def markup_text(markup: str) -> str:
    """X1 in full, as a scan of its pieces: an open entity swallows everything, tags too, up to the next `;`."""
    out, in_tag, entity = [], False, None
    for piece in re.findall(r"[<>&;]|[^<>&;]+", markup):
        if piece == "<":
            in_tag = True
            out.append(" ")
        elif piece == ">":
            in_tag = False
        elif piece == "&" and not in_tag:
            entity = ""
        elif piece == ";" and entity is not None:
            out.append(_entity(entity))
            entity = None
        elif entity is not None:
            entity += piece
        elif not in_tag:
            out.append(piece)
    return " ".join("".join(out).split())


def _entity(name: str) -> str:
    if name[:1] != "#":
        return ENTITIES.get(name, "")
    digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
    if not re.fullmatch(r"\+?[0-9a-fA-F]+" if base == 16 else r"\+?[0-9]+", digits):
        return ""
    point = int(digits, base)
    return "" if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF else chr(point)


def _markup_text(c: Column) -> Column:
    @F.arrow_udf("string")
    def helper(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A row at a time out of the batch and a piece of them back: most rows are null.
        for batch in batches:
            for at in range(0, len(batch), PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                yield pa.array([markup_text(m.as_py()) if m.is_valid else None for m in piece], pa.string())

    # A filter on the text does not make it again.
    return helper.asNondeterministic()(c)


def with_markup_text(df: DataFrame, markup: str, name: str, tags_first: bool = False) -> DataFrame:
    """df with the text of a markup column, in one pass: only rows with numbered entities or a bare `&`, which are few,
    are sent to Python; for the others it gets a null.

    tags_first: all rows by the built-in expressions, which take the tags out before they look for entities. An open
    entity then swallows the spaces of the tags in it too, and numbered entities are unknown ones."""
    if tags_first:
        return df.withColumn(name, simple_markup_text(F.col(markup)))
    odd = F.coalesce(F.col(markup).rlike(_ODD_MARKUP), F.lit(False))
    text = F.when(odd, _markup_text(F.when(odd, F.col(markup)))).otherwise(simple_markup_text(F.col(markup)))
    return df.withColumn(name, text)


def words(c: Column) -> Column:
    """Runs of letters and digits, each character lower-cased on its own (so a capital I with a dot, and a sigma at
    a word's end, take one plain letter)."""
    plain = F.translate(c, "İΣ", "iσ")
    return F.transform(F.filter(F.split(plain, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != ""), F.lower)


def quoted(text: str) -> str:
    """A Java pattern for the text itself."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _first(k: Column, side: Column, take) -> Column:
    """The fewest characters, taken from one side, that are CONTEXT bytes or more; all if there are fewer."""
    enough = F.filter(F.sequence(F.lit(1), F.lit(CONTEXT)), lambda n: F.octet_length(take(side, n)) >= CONTEXT)
    return F.coalesce(F.try_element_at(enough, F.lit(1)), k)


def snippet(body: Column, terms: list[str]) -> Column:
    """X4 and X5 for bodies whose lower-casing keeps every character's place."""
    terms = [t.lower() for t in terms if t]
    if not terms:
        return F.lit(None).cast(schema.SNIPPET)
    low = F.lower(body)
    at, size = F.lit(None).cast("int"), F.lit(0)
    for t in reversed(terms):
        place = F.locate(t, low)
        at, size = F.when(place > 0, place).otherwise(at), F.when(place > 0, len(t)).otherwise(size)
    before = F.substring(body, F.greatest(at - CONTEXT, F.lit(1)), F.least(at - 1, F.lit(CONTEXT)))
    after = F.substring(body, at + size, F.lit(CONTEXT))
    left = F.right(before, _first(F.length(before), before, F.right))
    right = F.left(after, _first(F.length(after), after, F.left))
    text = F.concat(left, F.substring(body, at, size), right)
    return F.when(at.isNotNull(), F.struct(text.alias("text"), highlights(text, terms).alias("highlights")))


def highlights(text: Column, terms: list[str]) -> Column:
    """For each term the byte ranges of its places, which do not overlap."""
    return F.flatten(F.array(*[_places(F.lower(text), t) for t in terms]))


def _places(low: Column, term: str) -> Column:
    size, parts = len(term.encode()), F.split(low, quoted(term), -1)

    def go_on(state: Column, part: Column) -> Column:
        start = (state.at + F.octet_length(part)).cast("int")
        return F.struct((start + size).alias("at"), F.concat(state.found, F.array(start)).alias("found"))

    start = F.expr("struct(0 as at, cast(array() as array<int>) as found)")
    starts = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, go_on, lambda state: state.found)
    return F.transform(starts, lambda a: F.struct(a.alias("start"), (a + size).alias("end")))


def snippet_of(body: str, terms: list[str]) -> dict | None:
    """X4 and X5 by bytes, where lower-casing changes lengths: places in the lower-cased body are taken as places in the
    body."""
    raw, low = body.encode(), body.lower().encode()
    terms = [t.lower().encode() for t in terms if t]
    hit = next(((low.find(t), len(t)) for t in terms if t in low), None)
    if hit is None:
        return None
    start, end = min(max(hit[0] - CONTEXT, 0), len(raw)), min(hit[0] + hit[1] + CONTEXT, len(raw))
    while 0 < start < len(raw) and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    text, found = raw[start:end], []
    lower, edges = text.decode().lower().encode(), {len(text)}
    edges |= {i for i in range(len(text)) if text[i] & 0xC0 != 0x80}
    for t in terms:
        at = lower.find(t)
        while at >= 0:
            if at in edges and at + len(t) in edges:
                found.append({"start": at, "end": at + len(t)})
            at = lower.find(t, at + len(t))
    return {"text": text.decode(), "highlights": found}


def with_snippet(hits: DataFrame, terms: list[str], by_bytes: bool = False) -> DataFrame:
    """hits(body, ...) with a snippet in place of the body. Null without terms, hit or body.

    by_bytes: bodies in which lower-casing changes the length of a character (few) are cut at the byte places of their
    lower-cased form, by an Arrow helper that gets nulls for all other rows."""
    if not any(terms):
        return hits.drop("body").withColumn("snippet", F.lit(None).cast(schema.SNIPPET))
    found = snippet(F.col("body"), terms)
    if by_bytes:
        low = F.lower("body")
        odd = (F.octet_length(low) != F.octet_length("body")) | (F.length(low) != F.length("body"))
        odd = F.coalesce(odd, F.lit(False))

        @F.pandas_udf(schema.SNIPPET)
        def helper(bodies: pd.Series) -> pd.DataFrame:
            rows = [(snippet_of(b, terms) if b is not None else None) or {"text": None, "highlights": None} for b in bodies]
            return pd.DataFrame(rows, columns=["text", "highlights"])

        hits = hits.withColumn("_odd", helper(F.when(odd, F.col("body"))))
        found = F.when(odd, F.when(F.col("_odd.text").isNotNull(), F.col("_odd"))).otherwise(found)
        return hits.withColumn("snippet", found).drop("body", "_odd")
    return hits.withColumn("snippet", found).drop("body")
