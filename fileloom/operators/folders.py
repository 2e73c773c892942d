"""Paths through renamed directories: folder names in versions, each valid from one rename to the next.

A directory that is renamed keeps what is in it. Its contents are a space of their own, and what changes is at which place
the space lies: a rename leaves a new, empty space at the old place and puts the moved one at the new place. A path at some
time is followed from folder to folder, at each place into the space that lies there then (the one of its versions whose
range holds the time). What is found, the name of a space and names below it, stays the same whatever is renamed later: so
the same thing has the same location at all times, and a location has one path at each time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r"[\\/]?[^\\/]*")


def _parts(path: str) -> list[str]:
    """The path's folders and name, each with the separator before it."""
    return [p for p in _PARTS.findall(path) if p]


class FolderNames:
    """The versions that renames (seq, old, new) of directories make, in the order of seq."""

    def __init__(self, renames: Iterable[tuple[int, str, str]]):
        #: By place, and by space: (seq, what lies there, or where it lies) from its first rename on.
        self.inside: dict[str, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        self.placed: dict[str, list[tuple[int, str]]] = defaultdict(list)
        #: (seq, space) of spaces that lay at a rename's new place before: if something is in one, it is seen beside
        #: what the rename brings.
        self.covered: list[tuple[int, str]] = []
        for seq, old, new in sorted(renames):
            if old == new:
                continue
            moved: list[str] = []
            for k, place in enumerate(self.locations(old, seq)):
                moved += self._spaces(place, seq)
                self._put(place, (f"\0{seq}.{k}",), seq)
            place = self.location(new, seq)
            there = [s for s in self._spaces(place, seq) if s not in moved]
            self.covered += [(seq, space) for space in there]
            self._put(place, (*moved, *there), seq)

    def _put(self, place: str, spaces: tuple[str, ...], seq: int) -> None:
        self.inside[place].append((seq, spaces))
        for space in spaces:
            self.placed[space].append((seq, place))

    def _spaces(self, place: str, upto: int) -> tuple[str, ...]:
        versions = self.inside.get(place)
        at = bisect_right(versions, upto, key=lambda v: v[0]) if versions else 0
        return versions[at - 1][1] if at else (place,)

    def locations(self, path: str, upto: int) -> list[str]:
        """Where the path leads after all renames up to this seq, the space that was moved last first."""
        found = [""]
        for k, part in enumerate(_parts(path)):
            found = [space + part for place in found for space in (self._spaces(place, upto) if k else (place,))]
        return found

    def location(self, path: str, upto: int) -> str:
        found = ""
        for k, part in enumerate(_parts(path)):
            found = (self._spaces(found, upto)[0] if k else "") + part
        return found

    def path(self, location: str, upto: int) -> str:
        """The path of a location after all renames up to this seq."""
        rest = ""
        while True:
            parts = _parts(location)
            for k in range(len(parts) - 1, 0, -1):
                space = "".join(parts[:k])
                versions = self.placed.get(space)
                at = bisect_right(versions, upto, key=lambda v: v[0]) if versions else 0
                if at and versions[at - 1][1] != space:
                    rest = "".join(parts[k:]) + rest
                    location = versions[at - 1][1]
                    break
            else:
                return location + rest

    def moved(self, path: str, since: int, until: int) -> str:
        """The path that lies there after the rename `since`, as it is just before the rename `until`."""
        return self.path(self.location(path, since), max(until - 1, since))


def location_of(shared, path: Column, upto: Column) -> Column:
    """shared: broadcast FolderNames."""

    @F.pandas_udf("string")
    def locate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = shared.value
        for paths, seqs in batches:
            yield pd.Series([None if p is None else names.location(p, int(s)) for p, s in zip(paths, seqs, strict=True)], dtype=object)

    return locate(path, upto)


def moved_path(shared, path: Column, since: Column, until: Column) -> Column:
    """shared: broadcast FolderNames."""

    @F.pandas_udf("string")
    def move(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = shared.value
        for paths, first, last in batches:
            rows = zip(paths, first, last, strict=True)
            yield pd.Series([None if p is None else names.moved(p, int(s), int(u)) for p, s, u in rows], dtype=object)

    return move(path, since, until)
