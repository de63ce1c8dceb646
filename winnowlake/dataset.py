"""An indexed dataset: a path, or a catalog table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, DataFrameReader
from pyspark.sql import functions as F

from . import config, errors, stats
from .errors import SkipError
from .identifiers import identifier
from .operators.builder import REFRESHED, STATUS, IndexBuilder, index_files
from .sources import files
from .sources.versions import OBJ_NAME, Status


class SkipDataset:
    """Life cycle of the indexes of one dataset; `session` is a SkipSession."""

    def __init__(self, session: Any, uri: str):
        self.session, self.spark, self.uri = session, session.spark, uri
        self.is_path = "/" in uri
        ident = identifier(session.conf)
        self.table_identifier = ident.table_identifier(uri) if self.is_path else self._table_name()

    def _table_name(self) -> str:
        parts = self.uri.split(".")
        if len(parts) > 2 or not all(parts):
            raise SkipError(errors.BAD_ID.format(self.uri))
        db = parts[0] if len(parts) == 2 else self.spark.catalog.currentDatabase()
        return f"{db}.{parts[-1]}"

    @property
    def manager(self):
        return self.session.manager

    @property
    def handle(self):
        return self.manager.handle(self.table_identifier)

    @property
    def conf(self) -> config.Conf:
        return self.handle.conf

    def set_params(self, params: dict[str, str]) -> None:
        """Settings of this dataset only."""
        self.handle.conf.set_all(params)
        self.handle.refresh()

    # -------------------------------------------------- data
    def check_table(self) -> None:
        if not self.spark.catalog.tableExists(self.uri):
            raise SkipError(errors.NO_TABLE.format(self.uri))
        if self.spark.catalog.getTable(self.uri).tableType in ("VIEW", "TEMPORARY"):
            raise SkipError(errors.VIEW.format(self.uri))
        if not files.partition_columns(files.relation(self.spark.table(self.uri))):
            raise SkipError(errors.NOT_PARTITIONED.format(self.uri))

    def frame(self, reader: DataFrameReader | DataFrame | None = None) -> DataFrame:
        if isinstance(reader, DataFrame):
            return reader
        if not self.is_path:
            return self.spark.table(self.uri)
        return (reader or self.spark.read.format("parquet")).load(self.uri)

    # -------------------------------------------------- life cycle
    def index_builder(self) -> IndexBuilder:
        return IndexBuilder(self)

    def is_indexed(self) -> bool:
        return self.handle.index_exists()

    def refresh_index(self, reader: DataFrameReader | DataFrame | None = None) -> DataFrame:
        """Index new and changed files, and drop what is gone; a changed file counts as both."""
        if not self.is_indexed():
            raise SkipError(errors.INDEX_NOT_FOUND)
        if not self.is_path:
            self.check_table()
        self.handle.refresh()
        added, removed = index_files(self.handle, self.frame(reader), self.handle.indexes(), refresh=True)
        return self.spark.createDataFrame([("SUCCESS", added, removed)], REFRESHED)

    def drop_index(self) -> DataFrame:
        if self.is_indexed():
            self.handle.drop_all_metadata()
        return self.spark.createDataFrame([("SUCCESS", None)], STATUS)

    def describe_index(self, reader: DataFrameReader | DataFrame | None = None) -> DataFrame:
        """Three text columns: what is indexed, on which columns, and the state of the metadata."""
        if not self.is_indexed():
            raise SkipError(errors.INDEX_NOT_FOUND)
        handle = self.handle
        rel = files.relation(self.frame(reader))
        ident = identifier(handle.conf)
        now, known = {files.named_id(f, ident) for f in files.listing(rel)}, set(handle.all_indexed_files())
        new, gone = len(now - known), len(known - now)
        state = "Up to date"
        if new:
            state = f"Out of date ({new} of {len(now)} objects are new, {100.0 * new / max(1, len(now)):.2f} %)"
        elif gone:
            state = f"Out of date ({gone} obsolete objects)"
        if handle.version_status() is not Status.CURRENT:
            state += f"; metadata version is {handle.version_status().value}"
        rows = [(self.uri, "", ""), ("Status", state, ""), ("Number of objects indexed", str(len(known)), ""), ("Metadata version", str(handle.version()), ""), ("Metadata location", handle.location(), "")]
        rows += [("Metadata property", f"{k}={v}", "") for k, v in sorted(handle.properties().items())]
        rows += [("Index type", "Columns", "Params")]
        rows += [(i.name, ",".join(i.cols), ",".join(f"{k}={v}" for k, v in sorted(i.params.items()))) for i in handle.indexes()]
        return self.spark.createDataFrame(rows, "`Data Skipping Index Stats` string, value string, comment string")

    # -------------------------------------------------- stats
    def latest_query_stats(self) -> DataFrame:
        found = self.handle.latest
        row = ("FAILED: No Data Was Supplied", *found.row()[1:]) if found is stats.NONE else found.row()
        return self.spark.createDataFrame([row], stats.SCHEMA)

    def metadata(self) -> DataFrame:
        return self.handle.metadata()

    def number_of_objects(self) -> int:
        return self.metadata().agg(F.countDistinct(OBJ_NAME)).first()[0]


