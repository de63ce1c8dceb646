"""What can be plugged in: index kinds, filters and translators."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from .config import IN_THRESHOLD, Conf
from .operators.indexes import BloomFilterIndex, Index, MinMaxIndex, RegexValueListIndex, ValueListIndex
from .plans.clauses import Clause, ValueListClause
from .plans.filters import BloomFilterFilter, MetadataFilter, MinMaxFilter, ValueListFilter
from .plans.predicate import Attr, Call, Expr, Lit
from .plans.translate import Translator, base_translator

IndexFactory = Callable[[dict[str, Any]], Index | None]
FilterFactory = Callable[[Index, Conf], MetadataFilter | None]


def base_index_factory(d: dict[str, Any]) -> Index | None:
    kinds = {k.name: k for k in (MinMaxIndex, ValueListIndex, BloomFilterIndex)}
    if d["name"] not in kinds:
        return None
    return kinds[d["name"]](*d["cols"], params=d.get("params"), key_metadata=d.get("key_metadata"))


def base_filter_factory(index: Index, conf: Conf) -> MetadataFilter | None:
    if isinstance(index, MinMaxIndex):
        return MinMaxFilter(index.cols[0], conf.of(IN_THRESHOLD))
    if isinstance(index, ValueListIndex):
        return ValueListFilter(index.cols[0])
    if isinstance(index, BloomFilterIndex):
        return BloomFilterFilter(index.cols[0])
    return None


def named(x: Any) -> Any:
    """What a dotted name stands for; a class without arguments is made, anything else is taken as it is."""
    if isinstance(x, str):
        module, _, name = x.rpartition(".")
        x = getattr(importlib.import_module(module), name)
    return x


def _function(x: Any) -> Any:
    x = named(x)
    return x() if isinstance(x, type) else x


class Registry:
    """Index factories and translators are put in front, filter factories behind; each once. Functions, classes
    whose objects are called, or the dotted names of either. Stores are classes like MetadataStoreManager."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.index_factories: list[IndexFactory] = [base_index_factory]
        self.filter_factories: list[FilterFactory] = [base_filter_factory]
        self.translators: list[Translator] = [base_translator]
        self.stores: dict[str, Any] = {}
        self._names: set[str] = set()

    def _new(self, f: Any, what: str) -> bool:
        """Whether a dotted name is registered for the first time."""
        if not isinstance(f, str):
            return True
        known = f"{what} {f}" in self._names
        self._names.add(f"{what} {f}")
        return not known

    def add_metadata_store(self, name: str, store: Any) -> None:
        """A store to be named by the setting `winnowlake.metadatastore`."""
        self.stores[name] = named(store)

    def add_index_factory(self, f: IndexFactory | str) -> None:
        if not self._new(f, "index"):
            return
        f = _function(f)
        if f not in self.index_factories:
            self.index_factories.insert(0, f)

    def add_clause_translator(self, f: Translator | str) -> None:
        if not self._new(f, "translator"):
            return
        f = _function(f)
        if f not in self.translators:
            self.translators.insert(0, f)

    def add_metadata_filter_factory(self, f: FilterFactory | str) -> None:
        if not self._new(f, "filter"):
            return
        f = _function(f)
        if f not in self.filter_factories:
            self.filter_factories.append(f)

    def index(self, d: dict[str, Any]) -> Index | None:
        return next((i for f in self.index_factories if (i := f(d)) is not None), None)

    def filters(self, indexes: list[Index], conf: Conf) -> list[MetadataFilter]:
        return [x for i in indexes for f in self.filter_factories if (x := f(i, conf)) is not None]


REGISTRY = Registry()


# ---------------------------------------------------------------- a plug-in that comes along
class RegexFilter(MetadataFilter):
    def __init__(self, index: RegexValueListIndex):
        self.index = index

    def clause(self, e: Expr) -> Clause | None:
        if not isinstance(e, Call) or e.name not in ("=", "in") or not isinstance(e.args[0], Call) or e.args[0].name != "regexp_extract":
            return None
        c, pattern, group = e.args[0].args
        values = e.args[1:]
        if not (isinstance(c, Attr) and c.name == self.index.cols[0] and isinstance(pattern, Lit) and isinstance(group, Lit)):
            return None
        if group.sql != "1" or pattern.sql != quoted(self.index.pattern) or not all(isinstance(v, Lit) and not v.is_null for v in values):
            return None
        return ValueListClause(f"regex:{self.index.cols[0]}:{self.index.pattern}", tuple(v.sql for v in values), False)


def quoted(s: str) -> str:
    """As Catalyst writes a string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex_index_factory(d: dict[str, Any]) -> Index | None:
    return RegexValueListIndex(d["cols"][0], params=d["params"]) if d["name"] == RegexValueListIndex.name else None


def regex_filter_factory(index: Index, conf: Conf) -> MetadataFilter | None:
    return RegexFilter(index) if isinstance(index, RegexValueListIndex) else None


def regex_translator(clause: Clause, lookup) -> Any:
    from pyspark.sql import functions as F

    if not isinstance(clause, ValueListClause) or not clause.column.startswith("regex:"):
        return None
    _, col, pattern = clause.column.split(":", 2)
    found = lookup(RegexValueListIndex.name, col)
    if not found or found[0].pattern != pattern:
        return None
    return found[1].isNotNull() & F.arrays_overlap(found[1], F.array(*[F.expr(x) for x in clause.literals]))


def register_regex_plugin(registry: Registry = REGISTRY) -> None:
    registry.add_index_factory(regex_index_factory)
    registry.add_metadata_filter_factory(regex_filter_factory)
    registry.add_clause_translator(regex_translator)
