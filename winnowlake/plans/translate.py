"""Clauses as Columns over the metadata table. The first translator that knows a clause wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bloom
from ..operators.indexes import BloomFilterIndex, Index, MinMaxIndex, ValueListIndex, plain
from .clauses import AndClause, BloomFilterClause, Clause, FalseClause, MinMaxClause, NotClause, OrClause, TrueClause, ValueListClause

#: Of a clause and (name, column) to (index, its metadata column).
Lookup = Callable[[str, str], tuple[Index, Column] | None]
Translator = Callable[[Clause, Lookup], Column | None]

_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def base_translator(clause: Clause, lookup: Lookup) -> Column | None:
    if isinstance(clause, (TrueClause, FalseClause)):
        return F.lit(isinstance(clause, TrueClause))
    if isinstance(clause, MinMaxClause):
        if not (found := lookup(MinMaxIndex.name, clause.column)):
            return None
        bound = found[1].getField("min" if clause.is_min else "max")
        return bound.isNotNull() & _OPS[clause.op](bound, F.expr(clause.literal))
    if isinstance(clause, ValueListClause):
        if not (found := lookup(ValueListIndex.name, clause.column)):
            return None
        index, values = found
        dtype: T.DataType = index.types[0]
        literals = F.array(*[plain(F.expr(x).cast(dtype), dtype) for x in clause.literals])
        if clause.negated:
            return values.isNotNull() & (F.size(F.array_except(values, literals)) > 0)
        return values.isNotNull() & F.arrays_overlap(values, literals)
    if isinstance(clause, BloomFilterClause):
        if not (found := lookup(BloomFilterIndex.name, clause.column)):
            return None
        index, words = found
        kind = index.types[0].simpleString()
        any_of = [bloom.might_contain(words, bloom.digest(F.expr(x), kind), index.bits, index.hashes) for x in clause.literals]
        return words.isNull() | reduce(lambda a, b: a | b, any_of)
    return None


def translate(clause: Clause, lookup: Lookup, translators: list[Translator]) -> Column | None:
    for t in translators:
        if (c := t(clause, lookup)) is not None:
            return c
    if isinstance(clause, (AndClause, OrClause)):
        a, b = (translate(x, lookup, translators) for x in (clause.left, clause.right))
        if a is None or b is None:
            return None
        return a & b if isinstance(clause, AndClause) else a | b
    if isinstance(clause, NotClause):
        c = translate(clause.clause, lookup, translators)
        return None if c is None else ~c
    return None
