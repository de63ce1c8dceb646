"""The metadata store: one row per file, in Parquet, one generation of files per change.

A change writes a new generation beside the current one; readers take the latest that is complete
(Spark commits a `_SUCCESS` mark last), so a change is seen whole or not at all. The generation before
stays for queries that are running; older ones go.
"""

from __future__ import annotations

import re
import threading
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, stats
from ..errors import INDEX_NOT_FOUND, NO_FOOTER_KEY, TOO_NEW, TOO_OLD, SkipError
from ..operators.indexes import BloomFilterIndex, Index
from ..registry import REGISTRY, Registry
from . import versions
from .paths import Folder, location
from .versions import OBJ_NAME, Status

_GENERATION = re.compile(r"gen-(\d{8})$")


class MetadataHandle(ABC):
    """What a store does for one dataset."""

    latest: stats.QueryStats = stats.NONE

    @abstractmethod
    def index_exists(self) -> bool: ...

    @abstractmethod
    def indexes(self) -> list[Index]: ...

    @abstractmethod
    def metadata(self) -> DataFrame: ...

    @abstractmethod
    def write(self, rows: DataFrame, indexes: list[Index], partitions: list[str], n_files: int) -> None: ...

    @abstractmethod
    def drop_all_metadata(self) -> None: ...

    @abstractmethod
    def not_required(self, clause: Column) -> list[str]: ...

    def all_indexed_files(self, where: Column | str | None = None) -> list[str]:
        """Ids of the indexed files; `where`: a predicate on the metadata, as of the virtual partition columns."""
        rows = self.metadata() if where is None else self.metadata().where(where)
        return [r[0] for r in rows.select(OBJ_NAME).distinct().collect()]

    def number_of_indexed_objects(self) -> int:
        return self.metadata().select(OBJ_NAME).distinct().count()

    def supports_encryption(self) -> bool:
        return False


class ParquetMetadataHandle(MetadataHandle):
    def __init__(self, spark: SparkSession, table_identifier: str, conf: config.Conf, registry: Registry):
        self.spark, self.table_identifier, self.registry = spark, table_identifier, registry
        self.conf = config.Conf(conf)
        self._cache: tuple[str, list[Index], int] | None = None
        self.latest = stats.NONE

    # -------------------------------------------------- where
    def location(self) -> str:
        return location(self.spark, self.conf, self.table_identifier)

    def _generations(self, folder: Folder) -> list[str]:
        found = sorted(n for n in folder.names() if _GENERATION.match(n))
        return [n for n in found if folder.exists(f"{n}/_SUCCESS")]

    def _current(self) -> str | None:
        """The folder of the rows: the latest whole generation, or files that lie flat (older layouts)."""
        try:
            where = self.location()
            folder = Folder(self.spark, where)
            if found := self._generations(folder):
                return f"{where}/{found[-1]}"
            return where if any(n.endswith(".parquet") for n in folder.names()) else None
        except Exception:  # a location that can't be resolved holds no index
            return None

    # -------------------------------------------------- reading
    def index_exists(self) -> bool:
        return self._current() is not None

    def refresh(self) -> None:
        self._cache = None

    def metadata(self) -> DataFrame:
        if not (where := self._current()):
            raise SkipError(INDEX_NOT_FOUND)
        return self.spark.read.parquet(where)

    def _load(self) -> tuple[str, list[Index], int]:
        where = self._current()
        if not where:
            raise SkipError(INDEX_NOT_FOUND)
        if self._cache and self._cache[0] == where:
            return self._cache
        schema = self.spark.read.parquet(where).schema
        version = int(schema[OBJ_NAME].metadata.get("version", 0))
        if versions.status(version) is Status.TOO_NEW:
            raise SkipError(TOO_NEW.format(version))
        if versions.status(version) is Status.DEPRECATED_UNSUPPORTED:
            raise SkipError(TOO_OLD.format(version))
        found = []
        for f in schema.fields:
            if d := versions.index_of(f.metadata or {}):
                index = self.registry.index(d)
                if index is None or version < versions.VERSION and isinstance(index, BloomFilterIndex):
                    continue
                found.append(index)
        self._cache = (where, found, version)
        return self._cache

    def indexes(self) -> list[Index]:
        return self._load()[1]

    def version(self) -> int:
        return self._load()[2]

    def properties(self) -> dict[str, str]:
        """What the metadata say of themselves, and the settings that shape them."""
        schema = self.metadata().schema
        found = {k: str(v) for k, v in schema[OBJ_NAME].metadata.items() if k in ("tableIdentifier", "generation", "encryption")}
        return found | {"files": str(len(self.metadata().inputFiles())), config.LOCATION_TYPE.key: self.conf.of(config.LOCATION_TYPE)}

    def version_status(self) -> Status:
        return versions.status(self.version())

    def metadata_column(self, index: Index) -> str:
        return versions.column_name(index.cols, index.name, self.version())

    def not_required(self, clause: Column) -> list[str]:
        """Ids of the files that the clause proves to hold no matching row."""
        rows = self.metadata()
        if self.conf.of(config.FILTER_DEDUP):
            rows = rows.dropDuplicates([OBJ_NAME])
        return [r[0] for r in rows.where(~clause).select(OBJ_NAME).collect()]

    # -------------------------------------------------- writing
    def supports_encryption(self) -> bool:
        return True

    def writer_options(self, indexes: list[Index]) -> dict[str, str]:
        """Keys for Parquet's modular encryption; they need a key service on Spark's class path."""
        keys: dict[str, list[str]] = {}
        for i in indexes:
            if i.key_metadata:
                keys.setdefault(i.key_metadata, []).append(versions.column_name(i.cols, i.name))
        footer = self.conf.of(config.FOOTER_KEY)
        if not keys and not footer:
            return {}
        if not footer:
            raise SkipError(NO_FOOTER_KEY)
        out = {"parquet.encryption.footer.key": footer, "parquet.encryption.plaintext.footer": str(self.conf.of(config.PLAIN_FOOTER)).lower()}
        if keys:
            out["parquet.encryption.column.keys"] = ";".join(f"{k}:{','.join(v)}" for k, v in keys.items())
        return out

    def parts(self, indexes: list[Index], n_files: int) -> int:
        """Files of metadata, and tasks that write them: none has more rows than a chunk, nor is it expected to
        be larger than a metadata file should be."""
        expected = n_files * (200 + sum(i.expected_bytes() for i in indexes))
        return max(1, -(-n_files // self.conf.of(config.CHUNK)), -(-expected // self.conf.of(config.MAX_FILE_BYTES)))

    def write(self, rows: DataFrame, indexes: list[Index], partitions: list[str], n_files: int) -> None:
        """rows (obj_name, virtual columns, one column per index) as the new state of the store."""
        named = {OBJ_NAME: {"version": versions.VERSION, "tableIdentifier": self.table_identifier}}
        footer = self.conf.of(config.FOOTER_KEY)
        if footer:
            named[OBJ_NAME]["encryption"] = {"footer_key": footer}
        columns = [OBJ_NAME, *(versions.virtual(p) for p in partitions)]
        for i in indexes:
            c = versions.column_name(i.cols, i.name)
            named[c] = {"index": i.to_dict()}
            columns.append(c)
        if self.conf.of(config.REFRESH_DEDUP):
            rows = rows.dropDuplicates([OBJ_NAME])
        where = self.location()
        folder = Folder(self.spark, where)
        old = sorted(n for n in folder.names() if _GENERATION.match(n))
        whole = self._generations(folder)
        new = f"gen-{(int(_GENERATION.match(old[-1])[1]) if old else 0) + 1:08d}"
        # the generation makes the field metadata new each time: Catalyst drops an alias whose metadata its
        # input already has, and the metadata are then lost where rows of the last generation are regrouped
        named = {c: d | {"generation": new} for c, d in named.items()}
        rows = rows.repartition(self.parts(indexes, n_files)).select(*[F.col(f"`{c}`").alias(c, metadata=named.get(c, {})) for c in columns])
        writer = rows.write.option("maxRecordsPerFile", self.conf.of(config.MAX_RECORDS))
        for k, v in self.writer_options(indexes).items():
            writer = writer.option(k, v)
        writer.parquet(f"{where}/{new}")
        for n in folder.names():
            if n in old and n not in whole[-1:] or n.endswith(".parquet"):
                folder.delete(n)
        self.refresh()
        self._set_property(where)

    def _set_property(self, where: str) -> None:
        """A dataset that is a catalog table, or names one, remembers where its metadata is."""
        name = self.conf.of(config.LOCATION) if self.conf.of(config.LOCATION_TYPE) == "HIVE_TABLE_NAME" else None
        if name:
            self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{config.LOCATION.key}' = '{where}')")

    def drop_all_metadata(self) -> None:
        if self._current():
            Folder(self.spark, self.location()).delete()
            if self.conf.of(config.LOCATION_TYPE) == "HIVE_TABLE_NAME":
                self.spark.sql(f"ALTER TABLE {self.conf.of(config.LOCATION)} UNSET TBLPROPERTIES IF EXISTS ('{config.LOCATION.key}')")
        self.refresh()

    def upgraded(self, rows: DataFrame, indexes: list[Index], version: int) -> DataFrame:
        """Rows of an older version under today's column names."""
        for i in indexes:
            rows = rows.withColumnRenamed(versions.column_name(i.cols, i.name, version), versions.column_name(i.cols, i.name))
        return rows


class MetadataStoreManager:
    """Handles by dataset, and the configuration they start from."""

    kind = "parquet"

    def __init__(self, spark: SparkSession, conf: config.Conf, registry: Registry | None = None):
        self.spark, self.conf, self.registry = spark, conf, registry or REGISTRY
        self.handles: dict[str, ParquetMetadataHandle] = {}
        self.lock = threading.Lock()
        self.stats_enabled = True

    def handle(self, table_identifier: str) -> ParquetMetadataHandle:
        with self.lock:
            if table_identifier not in self.handles:
                self.handles[table_identifier] = ParquetMetadataHandle(self.spark, table_identifier, self.conf, self.registry)
            return self.handles[table_identifier]

    def clear(self) -> None:
        with self.lock:
            self.handles.clear()

    def clear_stats(self) -> None:
        for h in list(self.handles.values()):
            h.latest = stats.NONE

    def aggregated(self) -> stats.QueryStats:
        if not self.stats_enabled:
            return stats.QueryStats("SUCCESS", False, 0, 0, 0, 0)
        return stats.total(h.latest for h in list(self.handles.values()) if h.latest is not stats.NONE)

    def indexed_datasets(self) -> list[tuple[str, str, list[Index]]]:
        """(table identifier, location, indexes) of all datasets under the base path."""
        if self.conf.of(config.LOCATION_TYPE) != "EXPLICIT_BASE_PATH_LOCATION":
            return []
        base = self.conf.of(config.LOCATION)
        out = []
        for name in sorted(Folder(self.spark, base).names()) if base else []:
            probe = ParquetMetadataHandle(self.spark, "", self.conf, self.registry)
            probe.location = lambda where=f"{base.rstrip('/')}/{name}": where
            if probe.index_exists():
                schema = probe.metadata().schema
                out.append((schema[OBJ_NAME].metadata.get("tableIdentifier", ""), probe.location(), probe.indexes()))
        return out
