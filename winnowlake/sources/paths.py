"""Where the metadata of a dataset is kept, and small file-system calls."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import SparkSession

from .. import config
from ..errors import NO_LOCATION, SkipError


def digest(table_identifier: str) -> str:
    return hashlib.sha256(table_identifier.encode()).hexdigest()


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def database_properties(spark: SparkSession, db: str) -> dict[str, str]:
    """From the catalog itself: DESCRIBE shows them as one text, in which a value can't be told for certain."""
    found = spark._jsparkSession.sessionState().catalog().getDatabaseMetadata(db).properties()
    out, it = {}, found.iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = pair._2()
    return out


def location(spark: SparkSession, conf: config.Conf, table_identifier: str) -> str:
    """The folder of a dataset's metadata, by the four location types."""
    where, kind, key = conf.of(config.LOCATION), conf.of(config.LOCATION_TYPE), config.LOCATION.key
    if not where:
        raise SkipError(NO_LOCATION)
    if kind == "EXPLICIT_LOCATION":
        return where
    if kind == "EXPLICIT_BASE_PATH_LOCATION":
        return f"{where.rstrip('/')}/{digest(table_identifier)}"
    if kind == "HIVE_TABLE_NAME":  # the name of a table that has the location, or whose database has a base
        found = table_properties(spark, where).get(key)
        if found:
            return found
        db = where.rpartition(".")[0] or spark.catalog.currentDatabase()
    else:
        db = where
    base = database_properties(spark, db).get(key)
    if not base:
        raise SkipError(NO_LOCATION)
    return f"{base.rstrip('/')}/{digest(table_identifier)}"


class Folder:
    """A folder of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def child(self, name: str) -> Any:
        return self._path(self.path, name)

    def exists(self, name: str = "") -> bool:
        return bool(self.fs.exists(self.child(name) if name else self.path))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.exists() else []

    def bytes(self, name: str) -> int:
        return int(self.fs.getContentSummary(self.child(name)).getLength()) if self.exists(name) else 0

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.child(name) if name else self.path, True)
