"""Multi-file copies of tables, for queries and tests: a table in one file has nothing to skip."""

from __future__ import annotations

import tempfile
import threading
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexes import BloomFilterIndex, Index, MinMaxIndex, ValueListIndex
from ..session import SkipSession
from .ranges import in_ranges

_lock = threading.Lock()

_FILTER = "spark.sql.optimizer.runtime.bloomFilter."
#: Joins of large tables: the rows whose keys the other side's predicates rule out don't reach the shuffle. Where the
#: scanned side is small nothing changes. (setting, Spark's default, ours)
FILTERS = (
    ("applicationSideScanSizeThreshold", "10737418240b", "64MB"), ("creationSideThreshold", "10485760b", "1GB"),
    ("expectedNumItems", "1000000", "4000000"), ("numBits", "8388608", "67108864"),
)


def filter_joins(spark: SparkSession) -> None:
    """Runtime filters of a size for large tables, in a session that has left their settings at their defaults."""
    if all(spark.conf.get(_FILTER + k) == default for k, default, _ in FILTERS):
        for k, _, ours in FILTERS:
            spark.conf.set(_FILTER + k, ours)


def scratch(spark: SparkSession) -> str:
    """A folder of this application, in the shared one if the cluster names it."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):  # executors would each write to their own disk
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:" + tempfile.mkdtemp(prefix="winnowlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/skip-{app}"


@dataclass(frozen=True)
class Layout:
    """How a table is laid out in files, and what is indexed."""

    table: str
    by: tuple[str, ...] = ()  # range-partitioned on these
    files: int = 16  # or more, for a view over a large table
    indexes: tuple[tuple, ...] = ()  # (kind, column[, parameters])
    format: str = "parquet"
    columns: tuple[str, ...] = ()  # SQL of derived columns
    partition_by: tuple[str, ...] = ()
    options: tuple[tuple[str, str], ...] = field(default=())

    @property
    def key(self) -> str:
        import hashlib

        return f"{self.table}_{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"


_KINDS: dict[str, Any] = {"minmax": MinMaxIndex, "valuelist": ValueListIndex, "bloom": BloomFilterIndex}


def made_indexes(layout: Layout) -> list[Index]:
    return [(_KINDS[k] if isinstance(k, str) else k)(col, **dict(rest[0] if rest else ())) for k, col, *rest in layout.indexes]


class Workspace:
    """The copies of the tables of one folder, indexed, each made once per application."""

    _all: dict[tuple[str, str], Workspace] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        import hashlib

        self.spark, self.sf_dir = spark, sf_dir
        filter_joins(spark)
        self.root = f"{scratch(spark)}/{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"
        self.session = SkipSession(spark).enable()
        self.session.set("winnowlake.parquet.mdlocation", f"{self.root}/metadata")
        self.made: set[str] = set()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, sf_dir)
        with _lock:
            if key not in cls._all:
                cls._all[key] = cls(spark, sf_dir)
            return cls._all[key]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def reader(self, layout: Layout):
        r = self.spark.read.format(layout.format).options(**dict(layout.options))
        if layout.format in ("csv", "json"):
            r = r.schema(self.read(layout.table).selectExpr("*", *layout.columns).schema)
        return r

    def path(self, layout: Layout) -> str:
        return f"{self.root}/{layout.key}"

    def write(self, layout: Layout, df: DataFrame, path: str, mode: str = "errorifexists", more: bool = False) -> None:
        """more: the files of the layout are the least there are; a large table has more."""
        if layout.by and more:
            df = in_ranges(df, layout.by, layout.files)
        elif layout.by:
            df = df.repartitionByRange(layout.files, *layout.by).sortWithinPartitions(*layout.by)
        else:
            df = df.repartition(layout.files)
        w = df.write.mode(mode).format(layout.format).options(**dict(layout.options))
        (w.partitionBy(*layout.partition_by) if layout.partition_by else w).save(path)

    def view(self, layout: Layout) -> str:
        """The name of a view over the indexed copy."""
        name, path = f"wl_{layout.key}", self.path(layout)
        if layout.key not in self.made:
            self.write(layout, self.read(layout.table).selectExpr("*", *layout.columns), path, "overwrite", more=True)
            if layout.indexes:
                builder = self.session.dataset(path).index_builder()
                for i in made_indexes(layout):
                    builder.add_custom_index(i)
                builder.build(self.reader(layout))
            self.made.add(layout.key)
        self.reader(layout).load(path).createOrReplaceTempView(name)
        return name

    def frame(self, layout: Layout) -> DataFrame:
        self.view(layout)
        return self.reader(layout).load(self.path(layout))

    def fresh(self, layout: Layout, name: str) -> str:
        """The path of a copy of its own, not indexed, that the caller may change."""
        import uuid

        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        self.write(layout, self.read(layout.table).selectExpr("*", *layout.columns), path)
        return path


def count_files(df: DataFrame) -> int:
    """Files that a query over one relation really reads."""
    return df.select(F.input_file_name().alias("f")).distinct().count()
