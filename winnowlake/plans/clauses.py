"""Clauses over file metadata.

A clause c represents a predicate e if every file with a row that satisfies e satisfies c; files that
don't satisfy c may be skipped.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Clause:
    pass


@dataclass(frozen=True)
class AndClause(Clause):
    left: Clause
    right: Clause


@dataclass(frozen=True)
class OrClause(Clause):
    left: Clause
    right: Clause


@dataclass(frozen=True)
class NotClause(Clause):
    clause: Clause


@dataclass(frozen=True)
class TrueClause(Clause):
    column: str


@dataclass(frozen=True)
class FalseClause(Clause):
    column: str


@dataclass(frozen=True)
class MinMaxClause(Clause):
    """The stored minimum or maximum of a column compared with a literal, given as SQL."""

    column: str
    op: str
    literal: str
    is_min: bool


@dataclass(frozen=True)
class ValueListClause(Clause):
    """The stored values overlap the literals; negated: some stored value is none of them."""

    column: str
    literals: tuple[str, ...]
    negated: bool


@dataclass(frozen=True)
class BloomFilterClause(Clause):
    """Some literal may be among the column's values."""

    column: str
    literals: tuple[str, ...]


def both(a: Clause | None, b: Clause | None) -> Clause | None:
    """AND: a side that is missing asks for nothing."""
    return AndClause(a, b) if a is not None and b is not None else a if b is None else b


def either(a: Clause | None, b: Clause | None) -> Clause | None:
    """OR: a side that is missing may hold anywhere."""
    return OrClause(a, b) if a is not None and b is not None else None
