"""A search as a value: what must match, what must not, filters, order and limit. Built by fileloom.jobs.compile from
text, or by hand; rendered to columns by filters, match and rank."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime


@dataclass(frozen=True)
class Pattern:
    """kind: plain, glob, regex, prefix, suffix or stem."""

    text: str
    kind: str = "plain"
    body_only: bool = False

    @classmethod
    def of(cls, text: str) -> Pattern:
        return cls(text, "glob" if "*" in text or "?" in text else "plain")

    def in_body(self) -> Pattern:
        return replace(self, body_only=True)

    @property
    def is_term(self) -> bool:
        """Whether the text itself can be looked for in names and bodies (kinds with an affix may hold a glob's signs)."""
        return self.kind not in ("glob", "regex")


#: An atom is one pattern or several alternatives.
Atom = tuple[Pattern, ...]


@dataclass(frozen=True)
class Compare:
    op: str  # > >= < <= =
    value: int


@dataclass
class Query:
    must: list[Atom] = field(default_factory=list)
    must_not: list[Pattern] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    size: Compare | None = None
    name_len: Compare | None = None
    ext_len: Compare | None = None
    depth: Compare | None = None
    no_ext: bool = False
    dotfile: bool = False
    after: datetime | None = None
    before: datetime | None = None
    name_only: bool = False
    files_only: bool = False
    folders_only: bool = False
    case_sensitive: bool = False
    whole_word: bool = False
    all_bits: int = 0
    any_bits: int = 0
    parent: str | None = None
    path_contains: str | None = None
    root: str | None = None
    sort: str = "score"
    limit: int | None = None

    @property
    def terms(self) -> list[str]:
        return [p.text for atom in self.must for p in atom if p.is_term]

    @property
    def needs_body(self) -> bool:
        """Whether a body can decide a match."""
        by_name = ("prefix", "suffix", "stem")
        must = any(
            all(p.body_only for p in a)
            or not (self.name_only or all(p.kind in by_name[:2] for p in a) or all(p.kind == "stem" for p in a))
            for a in self.must
        )
        return must or any(p.kind not in by_name for p in self.must_not)
