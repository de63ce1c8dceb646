"""Statistics of the latest query, per dataset and over all."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

SCHEMA = "status string, isSkippable boolean, skipped_Bytes long, skipped_Objs long, total_Bytes long, total_Objs long"


@dataclass(frozen=True)
class QueryStats:
    status: str
    is_skippable: bool
    skipped_bytes: int
    skipped_objs: int
    total_bytes: int
    total_objs: int

    def row(self) -> tuple:
        return astuple(self)


NONE = QueryStats("FAILED: no query has read the dataset", False, 0, 0, 0, 0)


def add(a: QueryStats, b: QueryStats) -> QueryStats:
    return QueryStats("SUCCESS", a.is_skippable or b.is_skippable, a.skipped_bytes + b.skipped_bytes, a.skipped_objs + b.skipped_objs, a.total_bytes + b.total_bytes, a.total_objs + b.total_objs)


def total(parts: Iterable[QueryStats]) -> QueryStats:
    out = None
    for p in parts:
        out = p if out is None else add(out, p)
    return NONE if out is None else out
