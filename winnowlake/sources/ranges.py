"""Ranges of rows of about equal bytes: how a copy of a table of any size is dealt out over files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows, as they are in memory, that a range has about.
RANGE_BYTES = 64 << 20
#: Rows looked at for each bound of ranges by bytes, and for all of them together.
LOOKED_AT, MOST_LOOKED_AT = 100, 1_000_000
#: Times the mean that the largest row may have for ranges of equal rows to do.
EVEN = 4


def _bytes(c: Column, dtype: T.DataType) -> tuple[int, list[Column]]:
    """Of a value: those that all values take, and those of its own."""
    if isinstance(dtype, T.StructType):
        parts = [_bytes(c.getField(f.name), f.dataType) for f in dtype.fields]
        return 8 + sum(n for n, _ in parts), [x for _, own in parts for x in own]
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return 8, [F.octet_length(c)]
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return 8, [F.octet_length(F.to_json(F.struct(c)))]
    return 8, []


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    parts = [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    out = F.lit(8 + sum(n for n, _ in parts)).cast("long")
    for x in (x for _, own in parts for x in own):
        out = out + F.coalesce(x, F.lit(0))
    return out


def in_ranges(df: DataFrame, by: tuple[str, ...], least: int) -> DataFrame:
    """df in at least so many ranges of `by`, each sorted; more for a larger table, so that a range stays about as large.

    Equal keys may go to more than one range then, else a frequent one would make a range as large as it likes."""
    size = row_bytes(df)
    total, most, rows = df.agg(F.sum(size), F.max(size), F.count(F.lit(1))).first()
    if not rows or total <= RANGE_BYTES:
        return df.repartitionByRange(least, *by).sortWithinPartitions(*by)
    n = max(least, math.ceil(total / RANGE_BYTES))
    block = max(0, int(math.log2(max(1, RANGE_BYTES / 64 / most))))  # rows told apart by blocks: the same in many rows, this takes little of a shuffle
    told = df.withColumn("__row", F.shiftright(F.monotonically_increasing_id(), block))
    keys = [*by, "__row"]
    if most <= EVEN * total / rows:
        dealt = told.repartitionByRange(n, *keys)
    else:
        dealt = told.repartitionById(n, _range_of(_bounds(told, size, keys, n, total), keys))
    return dealt.sortWithinPartitions(*by).drop("__row")


def _bounds(df: DataFrame, size: Column, keys: list[str], n: int, total: int) -> Column:
    """The first keys of all ranges but one, as a constant array: of rows looked at as often as their bytes say."""
    times = F.floor(size * (min(LOOKED_AT * n, MOST_LOOKED_AT) / total) + F.rand(17)).cast("int")
    looked = df.select(F.struct(*keys).alias("k"), times.alias("t")).where("t > 0").select("k", F.explode(F.array_repeat(F.lit(0), F.col("t")))).drop("col")
    row = looked.agg(F.array_sort(F.collect_list("k")).alias("a")).select(F.expr(f"transform(sequence(1, {n - 1}), i -> a[CAST(i * size(a) DIV {n} AS INT)])"))
    jvm = df.sparkSession._jvm
    array = row._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(array, row._jdf.schema().apply(0).dataType())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def _range_of(bounds: Column, keys: list[str]) -> Column:
    """The number of bounds that the keys of a row are not below, by halves."""
    key = F.struct(*keys)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))
