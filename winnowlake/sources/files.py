"""Files behind a DataFrame: listing without a scan, and predicates that prune while listing."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NOT_FILES, SkipError
from ..plans.predicate import kind, seq

if TYPE_CHECKING:
    from ..identifiers import Identifier

_STATUS = re.compile(r"path=(?P<path>.*?); isDirectory=false; length=(?P<len>\d+);.*?modification_time=(?P<time>\d+);")


@dataclass(frozen=True)
class File:
    path: str
    bytes: int
    modified_ms: int


_ID = "concat(_metadata.file_path, '#', unix_millis(_metadata.file_modification_time), '#', _metadata.file_size)"
#: Modification times of stores that keep them least exactly, in milliseconds.
GRANULE_MS = 1_000
#: Ids from which on a predicate takes them as one set of the JVM instead of SQL text.
MANY_IDS = 5_000


def file_id() -> Column:
    """The id of the file of each row: a constant of the file, so predicates on it prune the listing."""
    return F.expr(_ID)


def id_of(f: File) -> str:
    """file_id() of a listed file."""
    return f"{f.path}#{f.modified_ms}#{f.bytes}"


def named_id(f: File, ident: Identifier) -> str:
    """The id of a file in the metadata, as the identifier class gives it, with its size behind."""
    return f"{ident.file_id(f.path, f.modified_ms)}#{f.bytes}"


def pruned(df: DataFrame, ids: list[str], keep: bool = False) -> DataFrame:
    """df without the files of the ids (with keep: only those). Files that aren't known stay.

    The ids go to the JVM in one piece, however many there are: a Column for every literal would be a call
    each, and a long SQL text is slow to parse. Whether a file is among them is one look-up in a hash set.
    """
    if not ids:
        return df.where("false") if keep else df
    if len(ids) <= MANY_IDS:
        quoted = ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in ids)
        return df.where(F.expr(f"{_ID} {'IN' if keep else 'NOT IN'} ({quoted})"))
    spark = df.sparkSession
    jvm = spark._jvm
    row = spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string())})).agg(F.collect_list("id").alias("ids"))
    texts = getattr(jvm.org.apache.spark.sql.types, "StringType$").__getattr__("MODULE$")
    array = row._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0).toObjectArray(texts)
    found = jvm.PythonUtils.toSeq(jvm.java.util.Arrays.asList(array)).toSet()
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    among = jvm.org.apache.spark.sql.catalyst.expressions.InSet(utils.expression(F.expr(_ID)._jc), found)
    is_in = Column(utils.column(among))
    return df.where(is_in if keep else ~is_in)


def relation(df: DataFrame) -> Any:
    """The file relation a DataFrame reads and nothing else."""
    found = []

    def walk(node: Any) -> None:
        if kind(node) == "LogicalRelation":
            found.append(node)
        for c in seq(node.children()):
            walk(c)

    walk(df._jdf.queryExecution().analyzed())
    if len(found) != 1 or kind(found[0].relation()) != "HadoopFsRelation":
        raise SkipError(NOT_FILES)
    return found[0].relation()


def _index(rel: Any) -> Any:
    location = rel.location()
    if kind(location) == "CatalogFileIndex":
        return location.filterPartitions(_nil(rel))
    return location


def _nil(rel: Any) -> Any:
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    return jvm.PythonUtils.toSeq(jvm.java.util.ArrayList())


def encoded(path: str) -> str:
    """A path as _metadata.file_path has it."""
    from pyspark import SparkContext

    if re.fullmatch(r"[\w:/.=@~+,()!*$&-]*", path, re.A):
        return path
    return SparkContext._active_spark_context._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def listing(rel: Any, partition_filters: list[Any] | None = None) -> list[File]:
    """The files of a relation that aren't empty, after partition pruning if filters are given."""
    index = _index(rel)
    if partition_filters:
        from pyspark import SparkContext

        jvm = SparkContext._active_spark_context._jvm
        filters = jvm.java.util.ArrayList()
        for f in partition_filters:
            filters.add(f)
        text = "\n".join(d.files().mkString("\n") for d in seq(index.listFiles(jvm.PythonUtils.toSeq(filters), _nil(rel))))
    else:
        text = index.allFiles().mkString("\n")
    found = (File(encoded(m["path"]), int(m["len"]), int(m["time"])) for m in _STATUS.finditer(text))
    return [f for f in found if f.bytes > 0 and not unquote(f.path).rsplit("/", 1)[-1].startswith(("_", "."))]


def settled(rel: Any) -> list[File]:
    """The files of a relation, none younger than a granule of modification times: else one could be written
    again, with the same id, while it is indexed. Waits for that, and leaves out files of the future."""
    found = listing(rel)
    now = time.time() * 1000
    newest = max((f.modified_ms for f in found if f.modified_ms <= now), default=0)
    if (wait := newest + GRANULE_MS + 1 - now) > 0:
        time.sleep(wait / 1000)
        rel.location().refresh()
        found = listing(rel)
        now = time.time() * 1000
    return [f for f in found if f.modified_ms + GRANULE_MS < now]


def partition_columns(rel: Any) -> list[str]:
    return list(rel.partitionSchema().fieldNames())


def root_paths(rel: Any) -> list[str]:
    location = rel.location()
    return [p.toString() for p in seq(location.rootPaths())]
