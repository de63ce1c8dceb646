"""Indexes: what is kept of a column for every file, as aggregate columns.

An index yields its metadata in one of two ways: `aggregate` gives an aggregate Column for the one
groupBy over all files; `rows` gives a DataFrame of file id and metadata of its own. All bloom filters
of a build come from one scan more (`bloom_rows`).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bloom

ORDERED = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def column(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def plain(c: Column, dtype: T.DataType) -> Column:
    """One zero: -0.0 equals 0.0 in a predicate, but not in a set of values."""
    return c + F.lit(0.0).cast(dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c


class Index:
    """Base of all indexes; subclasses set `name` and give `valid` and `aggregate` (or `rows`)."""

    name = ""

    def __init__(self, *cols: str, params: dict[str, str] | None = None, key_metadata: str | None = None):
        self.cols = tuple(c.lower() for c in cols)
        self.params = {k: str(v) for k, v in (params or {}).items()}
        self.key_metadata = key_metadata
        self.types: tuple[T.DataType, ...] = ()
        self.names: tuple[str, ...] = self.cols  # as the data spells them

    def resolve(self, fields: dict[str, tuple[str, T.DataType]]) -> None:
        self.names = tuple(fields[c][0] for c in self.cols)
        self.types = tuple(fields[c][1] for c in self.cols)

    def valid(self, dtype: T.DataType) -> bool:
        raise NotImplementedError

    def aggregate(self) -> Column | None:
        return None

    def rows(self, base: DataFrame, file_id: Column) -> DataFrame | None:
        """Columns obj_name and value."""
        return None

    def expected_bytes(self) -> int:
        """Of the metadata of one file, about."""
        return 64

    def same(self, other: Index) -> bool:
        return (self.name, self.cols) == (other.name, other.cols)

    def to_dict(self) -> dict[str, Any]:
        out = {"name": self.name, "cols": list(self.cols), "params": self.params}
        return out | ({"key_metadata": self.key_metadata} if self.key_metadata else {})

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(self.cols)})"


class MinMaxIndex(Index):
    name = "minmax"

    def valid(self, dtype: T.DataType) -> bool:
        return isinstance(dtype, ORDERED)

    def aggregate(self) -> Column:
        c = column(self.names[0])
        return F.struct(F.min(c).alias("min"), F.max(c).alias("max"))


class ValueListIndex(Index):
    name = "valuelist"

    def valid(self, dtype: T.DataType) -> bool:
        return isinstance(dtype, ORDERED)

    def aggregate(self) -> Column:
        return F.collect_set(plain(column(self.names[0]), self.types[0]))


class BloomFilterIndex(Index):
    name = "bloomfilter"

    def __init__(self, *cols: str, fpp: float = 0.01, ndv: int = 100_000, params: dict[str, str] | None = None, key_metadata: str | None = None):
        params = dict(params or {})
        fpp, ndv = float(params.get("fpp", fpp)), int(params.get("ndv", ndv))
        super().__init__(*cols, params={**params, "fpp": fpp, "ndv": ndv}, key_metadata=key_metadata)
        self.bits, self.hashes = bloom.size(ndv, fpp)

    def valid(self, dtype: T.DataType) -> bool:
        """Not strings with a collation: what is equal under it has other hashes."""
        return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(dtype, T.StringType) and dtype.simpleString() == "string"

    def expected_bytes(self) -> int:
        """Of a full filter, in memory: words with their places."""
        return self.bits // 64 * 12


def bloom_rows(base: DataFrame, file_id: Column, indexes: list[BloomFilterIndex]) -> DataFrame:
    """obj_name and the words of the filters (value_0, value_1, ...) of every file with values: one scan for
    all filters; bits are joined in the map-side aggregation, so equal values cost nothing more."""
    digests = [F.struct(F.lit(k).alias("k"), bloom.digest(column(i.names[0]), i.types[0].simpleString()).alias("h"), column(i.names[0]).isNull().alias("none")) for k, i in enumerate(indexes)]
    rows = base.select(file_id.alias("obj_name"), F.inline(F.array(*digests))).where("not none")
    positions = F.lit(None).cast("array<bigint>")
    for k, i in enumerate(indexes):
        positions = F.when(F.col("k") == k, bloom.positions(F.col("h"), i.bits, i.hashes)).otherwise(positions)
    at = rows.select("obj_name", "k", F.explode(positions).alias("p"))
    one = F.expr("shiftleft(1L, CAST(pmod(p, 64) AS INT))")
    words = at.groupBy("obj_name", "k", F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("bits"))
    of = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("k") == k, F.struct("w", "bits")))).alias(f"value_{k}")
    return words.groupBy("obj_name").agg(*[of(k) for k in range(len(indexes))])


class RegexValueListIndex(Index):
    """The distinct matches of a pattern's first group; skips on regexp_extract(c, pattern, 1) = '...'."""

    name = "regexvaluelist"

    def __init__(self, col: str, pattern: str | None = None, params: dict[str, str] | None = None, key_metadata: str | None = None):
        params = dict(params or {})
        self.pattern = pattern if pattern is not None else params["pattern"]
        super().__init__(col, params=params | {"pattern": self.pattern}, key_metadata=key_metadata)

    def valid(self, dtype: T.DataType) -> bool:
        return isinstance(dtype, T.StringType)

    def aggregate(self) -> Column:
        return F.collect_set(F.regexp_extract(column(self.names[0]), self.pattern, 1))


def flat_fields(schema: T.StructType, prefix: str = "") -> dict[str, tuple[str, T.DataType]]:
    """Leaves and structs of a schema: lower-case dotted name to (name, type)."""
    out: dict[str, tuple[str, T.DataType]] = {}
    for f in schema.fields:
        name = prefix + f.name
        out[name.lower()] = (name, f.dataType)
        if isinstance(f.dataType, T.StructType):
            out |= flat_fields(f.dataType, name + ".")
    return out


def dotted(schema: T.StructType) -> list[str]:
    """Field names that hold a dot, at any depth."""
    out = []
    for f in schema.fields:
        if "." in f.name:
            out.append(f.name)
        if isinstance(f.dataType, T.StructType):
            out += dotted(f.dataType)
    return out
