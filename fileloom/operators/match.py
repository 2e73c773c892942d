"""Text predicates as columns. A pattern is tried on a field; a field is given with its lower-cased form, so that a body
is lower-cased once for all atoms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileloom.functions import derive
from fileloom.operators.query import Atom, Pattern, Query

_WORD = r"[\p{IsAlphabetic}\p{N}]"


@dataclass(frozen=True)
class Field:
    raw: Column
    lower: Column


def _like(pattern: str) -> str:
    """A glob as LIKE, runs of * as one."""
    out = ""
    for c in pattern:
        if c == "*":
            out += "" if out.endswith("%") and not out.endswith(r"\%") else "%"
        else:
            out += "_" if c == "?" else "\\" + c if c in "%_\\" else c
    return out


def _quote(c: str) -> str:
    return c if c.isalnum() or c.isspace() and c != "\n" else f"\\x{{{ord(c):x}}}"


def dialect_regex(pattern: str) -> str:
    """The small dialect (any, star, very start, very end, all else literal) as a Java pattern. A star after nothing, an
    anchor or another star has no meaning and is dropped."""
    parts: list[str] = []
    for c in pattern:
        if c == "*":
            if parts and not parts[-1].endswith("*") and parts[-1] not in (r"\A", r"\z"):
                parts[-1] += "*"
        else:
            parts.append({".": ".", "^": r"\A", "$": r"\z"}.get(c) or f"(?:{_quote(c)})")
    return "(?s)" + "".join(parts)


def _contains(f: Field, text: str, q: Query) -> Column:
    if not text:
        return F.lit(True)
    if q.whole_word:
        text = text if q.case_sensitive else text.lower()
        hay, quoted = f.raw if q.case_sensitive else f.lower, "".join(map(_quote, text))
        # The pattern is tried only where the text is at all.
        return hay.contains(text) & hay.rlike(f"(?s)(?<!{_WORD}){quoted}(?!{_WORD})")
    return f.raw.contains(text) if q.case_sensitive else f.lower.contains(text.lower())


def pattern_matches(p: Pattern, f: Field, q: Query) -> Column:
    cased = q.case_sensitive
    hay, text = (f.raw, p.text) if cased else (f.lower, p.text.lower())
    if p.kind == "regex":
        return hay.rlike(dialect_regex(text))
    if p.kind == "glob":
        return hay.like(_like(text))
    if p.kind == "prefix":
        return hay.startswith(text) if text else F.lit(True)
    if p.kind == "suffix":
        return hay.endswith(text) if text else F.lit(True)
    if p.kind == "stem":
        own = derive.stem(derive.last_component(f.raw))
        return _contains(Field(own, F.lower(own)), p.text, q)
    return _contains(f, p.text, q)


def _any(patterns: Atom, f: Field, q: Query) -> Column:
    return reduce(or_, (pattern_matches(p, f, q) for p in patterns))


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def in_body(patterns: Atom, body: Field, q: Query) -> Column:
    """Whether any of the patterns is in the body. Decided where the body is read."""
    return _false_if_null(_any(patterns, body, q))


def atom_matches(atom: Atom, name: Field, path: Field, body: Column, q: Query) -> tuple[Column, Column, Column]:
    """Whether the atom is in the name, in the path, in the body (body: whether it is, see in_body). Alternatives that
    are not all of one kind lose the limit to a field that each would have alone."""
    no = F.lit(False)
    if all(p.body_only for p in atom):
        return no, no, body
    in_name = _any(atom, name, q)
    if q.name_only or all(p.kind in ("prefix", "suffix") for p in atom) or all(p.kind == "stem" for p in atom):
        return in_name, no, no
    return in_name, _any(atom, path, q), body


def only_names(p: Pattern) -> bool:
    return p.kind in ("prefix", "suffix", "stem")


def excluded(p: Pattern, name: Field, path: Field, body: Column, q: Query) -> Column:
    found = pattern_matches(p, name, q)
    return found if only_names(p) else found | pattern_matches(p, path, q) | body


def narrowing_prefix(q: Query) -> str | None:
    """If the first atom is one term of two characters or more that the name must begin with, or that is looked for in
    names alone, only names that begin with it are candidates. So `n:report` does not find `alpha-report.txt`."""
    if q.must and len(q.must[0]) == 1:
        (p,) = q.must[0]
        by_name = p.kind == "prefix" or q.name_only
        if p.is_term and p.kind != "suffix" and not p.body_only and len(p.text) >= 2 and by_name:
            return p.text
    return None


def names_with_prefix(name: Column, prefix: str) -> Column:
    """A-Z and a-z are alike; the empty prefix has no names."""
    if not prefix:
        return F.lit(False)
    text = "".join(c.lower() if c.isascii() else c for c in prefix)
    return derive.ascii_lower(name).startswith(text)


def every(columns: list[Column]) -> Column:
    return reduce(and_, columns, F.lit(True))
