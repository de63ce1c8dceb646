"""Building and refreshing indexes: one grouped pass over the files that are new."""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader
from pyspark.sql import functions as F

from .. import config, errors
from ..errors import SkipError
from ..identifiers import Identifier, identifier
from ..sources import files, versions
from ..sources.store import ParquetMetadataHandle
from ..sources.versions import OBJ_NAME
from .indexes import BloomFilterIndex, Index, MinMaxIndex, ValueListIndex, bloom_rows, dotted, flat_fields

STATUS = "status string, reason string"
REFRESHED = "status string, new_entries_added int, old_entries_removed int"


class IndexBuilder:
    def __init__(self, dataset: Any):
        self.dataset, self.indexes = dataset, []

    def add_min_max_index(self, col: str, key_metadata: str | None = None) -> IndexBuilder:
        return self.add_custom_index(MinMaxIndex(col, key_metadata=key_metadata))

    def add_value_list_index(self, col: str, key_metadata: str | None = None) -> IndexBuilder:
        return self.add_custom_index(ValueListIndex(col, key_metadata=key_metadata))

    def add_bloom_filter_index(self, col: str, fpp: float | None = None, ndv: int | None = None, key_metadata: str | None = None) -> IndexBuilder:
        conf = self.dataset.conf
        fpp = conf.of(config.BLOOM_FPP) if fpp is None else fpp
        return self.add_custom_index(BloomFilterIndex(col, fpp=fpp, ndv=conf.of(config.BLOOM_NDV) if ndv is None else ndv, key_metadata=key_metadata))

    def add_custom_index(self, index: Index | type | str, cols: list[str] | None = None, params: dict[str, str] | None = None, key_metadata: str | None = None) -> IndexBuilder:
        """An index object, or the class (or its dotted name) with columns and parameters."""
        if isinstance(index, str):
            import importlib

            module, _, name = index.rpartition(".")
            index = getattr(importlib.import_module(module), name)
        if isinstance(index, type):
            index = index(*(cols or []), params=params, key_metadata=key_metadata)
        self.indexes.append(index)
        return self

    def build(self, reader: DataFrameReader | DataFrame | None = None) -> DataFrame:
        """Index the dataset; a reader for a path, nothing for a catalog table."""
        d = self.dataset
        if d.is_path:
            if re.search(r"[{}\[\]*?\\]", d.uri):
                raise SkipError(errors.GLOB.format(d.uri))
        else:
            d.check_table()
        if d.is_indexed():
            raise SkipError(errors.ALREADY_INDEXED)
        index_files(d.handle, d.frame(reader), self.indexes, refresh=False)
        d.manager.handle(d.table_identifier).refresh()
        return d.spark.createDataFrame([("SUCCESS", None)], STATUS)


def validate(handle: ParquetMetadataHandle, df: DataFrame, indexes: list[Index], partitions: list[str]) -> None:
    if not indexes:
        raise SkipError(errors.NO_INDEXES)
    if bad := dotted(df.schema):
        raise SkipError(errors.BAD_SCHEMA.format(", ".join(bad)))
    for k, i in enumerate(indexes):
        if any(i.same(j) for j in indexes[:k]):
            raise SkipError(errors.DUPLICATE.format(i))
    if any(i.key_metadata for i in indexes) and not handle.supports_encryption():
        raise SkipError(errors.NO_ENCRYPTION)
    handle.writer_options(indexes)
    fields, parts = flat_fields(df.schema), {p.lower() for p in partitions}
    for i in indexes:
        for c in i.cols:
            if c not in fields:
                raise SkipError(errors.NO_COLUMN.format(c))
            if c in parts:
                raise SkipError(errors.PARTITION_COLUMN.format(c))
            if not i.valid(fields[c][1]):
                raise SkipError(errors.BAD_TYPE.format(i.name, c, fields[c][1].simpleString()))
        i.resolve(fields)


def collected(df: DataFrame, indexes: list[Index], partitions: list[str], listed: list[files.File], ident: Identifier) -> DataFrame:
    """obj_name, virtual columns and index columns of every listed file; nulls for files without rows."""
    spark = df.sparkSession
    aggregates = [F.first(F.col(f"`{p}`")).alias(versions.virtual(p)) for p in partitions]
    separate = []
    blooms = [i for i in indexes if isinstance(i, BloomFilterIndex)]
    for i in indexes:
        name = versions.column_name(i.cols, i.name)
        if isinstance(i, BloomFilterIndex):
            continue
        if (agg := i.aggregate()) is not None:
            aggregates.append(agg.alias(name))
        else:
            separate.append(i.rows(df, files.file_id()).withColumnRenamed("value", name))
    rows = df.groupBy(files.file_id().alias(OBJ_NAME)).agg(F.count(F.lit(1)).alias("__n"), *aggregates).drop("__n")
    out = spark.createDataFrame(pa.table({OBJ_NAME: pa.array([files.id_of(f) for f in listed], pa.string()), "__named": pa.array([files.named_id(f, ident) for f in listed], pa.string())})).join(rows, OBJ_NAME, "left")
    for found in separate:
        out = out.join(found, OBJ_NAME, "left")
    if blooms:
        out = out.join(bloom_rows(df, files.file_id(), blooms), OBJ_NAME, "left")
        for k, i in enumerate(blooms):  # a file without values has an empty filter
            out = out.withColumn(versions.column_name(i.cols, i.name), F.coalesce(F.col(f"value_{k}"), F.expr("CAST(map() AS MAP<INT, BIGINT>)"))).drop(f"value_{k}")
    return out.withColumn(OBJ_NAME, F.col("__named")).drop("__named")


def index_files(handle: ParquetMetadataHandle, df: DataFrame, indexes: list[Index], refresh: bool) -> tuple[int, int]:
    """Bring the store up to date; (files added, rows removed)."""
    rel = files.relation(df)
    partitions = files.partition_columns(rel)
    validate(handle, df, indexes, partitions)
    listed, ident = files.settled(rel), identifier(handle.conf)
    if not refresh:
        handle.write(collected(df, indexes, partitions, listed, ident), indexes, partitions, len(listed))
        return len(listed), 0
    version, old = handle.version(), handle.metadata()
    now = {files.named_id(f, ident): f for f in listed}
    known = {r[0] for r in old.select(OBJ_NAME).distinct().collect()}
    if version < versions.PARTITIONS_SINCE and partitions:  # older rows lack partition values: collect anew
        known, removed = set(), len(known)
    else:
        removed = len(known - now.keys())
    new = [f for k, f in now.items() if k not in known]
    gone = [x for x in known if x not in now]
    kept = handle.upgraded(old, indexes, version) if known else None
    if kept is not None and gone:
        spark = df.sparkSession
        kept = kept.join(spark.createDataFrame(pa.table({OBJ_NAME: pa.array(gone, pa.string())})), OBJ_NAME, "left_anti")
    parts = [kept] if kept is not None else []
    if new or not parts:
        fresh = files.pruned(df, [files.id_of(f) for f in new], keep=True)
        parts.append(collected(fresh, indexes, partitions, new, ident))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*[f"`{c}`" for c in p.columns]), allowMissingColumns=True)
    handle.write(rows, indexes, partitions, len(now))
    return len(new), removed


