"""Registered queries: each runs through the skipping path; its SQL is the plain query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators.indexes import RegexValueListIndex
from .registry import register_regex_plugin
from .sources import files, versions
from .sources.layouts import Layout, Workspace

LINEITEM = Layout("lineitem", ("l_orderkey",), 16, (("minmax", "l_orderkey"), ("valuelist", "l_returnflag"), ("valuelist", "l_linenumber"), ("minmax", "l_quantity")))
SHIPPED = Layout("lineitem", ("l_shipdate",), 16, (("minmax", "l_shipdate"), ("minmax", "l_discount")))
ORDERS = Layout("orders", ("o_orderkey",), 12, (("minmax", "o_orderkey"), ("minmax", "o_orderdate")))
DATED = Layout("orders", ("o_orderdate",), 12, (("minmax", "o_orderdate"),))
PRIORITY = Layout("orders", ("o_orderpriority",), 8, (("valuelist", "o_orderpriority"), ("valuelist", "o_orderstatus")))
FLAGGED = Layout("orders", ("o_orderstatus", "o_orderkey"), 8, (("valuelist", "is_open"), ("minmax", "maybe")), columns=("o_orderstatus = 'O' AS is_open", "CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS maybe"))
CUSTOMER = Layout("customer", ("c_acctbal",), 8, (("minmax", "c_acctbal"), ("bloom", "c_name", (("ndv", 500),)), ("valuelist", "c_mktsegment")))
BY_KEY = Layout("customer", ("c_custkey",), 8, (("minmax", "c_custkey"),))
PART = Layout("part", ("p_name",), 8, (("minmax", "p_name"), ("valuelist", "p_brand"), ("bloom", "p_size", (("ndv", 100),))))
EVENTS = Layout("events", ("user_id",), 10, (("bloom", "user_id", (("ndv", 1000),)), ("minmax", "ts")))
BY_TYPE = Layout("events", ("value",), 4, (("minmax", "value"),), partition_by=("event_type",))
NARROW = Layout("part", ("p_size",), 8, (("bloom", "as_short", (("ndv", 100),)), ("bloom", "as_byte", (("ndv", 100),))), columns=("CAST(p_size AS SMALLINT) AS as_short", "CAST(p_size AS TINYINT) AS as_byte"))
TAGGED = Layout("events", ("value",), 8, (("minmax", "value"),))
NESTED = Layout("events", ("value",), 8, (("minmax", "s.v"), ("valuelist", "s.inner.kind")), columns=("named_struct('v', value, 'inner', named_struct('kind', event_type)) AS s",))
SUPPLIER = Layout("supplier", ("s_suppkey",), 4, (("minmax", "s_suppkey"),))
NATION = {f: Layout("nation", ("n_nationkey",), 5, (("minmax", "n_nationkey"),), format=f, options=(("header", "true"),) if f == "csv" else ()) for f in ("parquet", "csv", "json", "orc")}
HOST = r"^[a-z]+://([a-z]+)[.]"  # the first label of the host
PAGES = Layout("pages", ("url",), 8, ((RegexValueListIndex, "url", (("pattern", HOST),)),))
DOCUMENTS = Layout("documents", ("n_chars",), 8, (("minmax", "n_chars"), ("valuelist", "lang")))

_TABLES = {
    "lineitem": LINEITEM, "shipped": SHIPPED, "orders": ORDERS, "dated": DATED, "priority": PRIORITY, "flagged": FLAGGED, "customer": CUSTOMER, "by_key": BY_KEY, "part": PART, "events": EVENTS,
    "by_type": BY_TYPE, "nested": NESTED, "narrow": NARROW, "tagged": TAGGED, "supplier": SUPPLIER, "nation": NATION["parquet"], "nation_csv": NATION["csv"], "nation_json": NATION["json"], "nation_orc": NATION["orc"], "pages": PAGES, "documents": DOCUMENTS,
}

_L = "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE "
_O = "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE "

#: Queries whose SQL both engines read; {name} stands for a layout there and for its table here.
SQL: dict[str, str] = {
    "minmax_gt": _L + "l_orderkey > 1200",
    "minmax_ge": _L + "l_orderkey >= 1200",
    "minmax_lt": _L + "l_orderkey < 200",
    "minmax_le": _L + "l_orderkey <= 200",
    "minmax_eq": _L + "l_orderkey = 77",
    "minmax_flipped": _L + "200 > l_orderkey",
    "minmax_ne": _L + "l_orderkey <> 77",
    "minmax_between": "SELECT l_orderkey, l_linenumber FROM {shipped} WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-06-30 00:00:00'",
    "minmax_in_small": _O + "o_orderkey IN (3, 900, 901)",
    "minmax_in_large": _O + "o_orderkey IN (3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29)",
    "minmax_double": "SELECT c_custkey FROM {customer} WHERE c_acctbal > 9000.0",
    "minmax_string": "SELECT p_partkey, p_name FROM {part} WHERE p_name < 'm'",
    "minmax_null_column": "SELECT o_orderkey FROM {flagged} WHERE {maybe} > 100000.0",
    "vlist_eq": "SELECT o_orderkey FROM {priority} WHERE o_orderpriority = '1-URGENT'",
    "vlist_in": "SELECT o_orderkey FROM {priority} WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
    "vlist_ne": "SELECT o_orderkey FROM {priority} WHERE o_orderpriority <> '1-URGENT'",
    "vlist_not_in": "SELECT o_orderkey FROM {priority} WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    "vlist_bool": "SELECT o_orderkey FROM {flagged} WHERE {is_open}",
    "vlist_not_bool": "SELECT o_orderkey FROM {flagged} WHERE NOT {is_open}",
    "bloom_eq_long": "SELECT event_id, user_id FROM {events} WHERE user_id = 7",
    "bloom_in_long": "SELECT event_id, user_id FROM {events} WHERE user_id IN (7, 11, 100000)",
    "bloom_inset": f"SELECT event_id, user_id FROM {{events}} WHERE user_id IN (7, {', '.join(str(k) for k in range(1_000_000, 1_000_040))})",
    "bloom_eq_short": "SELECT p_partkey FROM {narrow} WHERE {as_short} = CAST(7 AS SMALLINT)",
    "bloom_eq_byte": "SELECT p_partkey FROM {narrow} WHERE {as_byte} = CAST(7 AS TINYINT)",
    "bloom_in_null": "SELECT event_id FROM {events} WHERE user_id IN (7, NULL)",
    "vlist_inset": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_linenumber IN (7, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22)",
    "vlist_not_in_null": "SELECT o_orderkey FROM {priority} WHERE o_orderpriority NOT IN ('1-URGENT', NULL)",
    "minmax_in_null": _O + "o_orderkey IN (NULL, 3)",
    "minmax_none_match": _O + "o_orderkey < 0",
    "not_and_or": _L + "NOT (l_orderkey < 1000 OR (l_quantity <= 5 AND l_linenumber <> 2))",
    "bloom_eq_int": "SELECT p_partkey FROM {part} WHERE p_size = 7",
    "bloom_eq_string": "SELECT c_custkey FROM {customer} WHERE c_name = 'Customer#000000007'",
    "and_mixed": _L + "l_orderkey < 900 AND l_returnflag = 'R'",
    "or_mixed": _L + "l_orderkey < 100 OR l_orderkey > 1400",
    "or_unindexed": _L + "l_orderkey < 100 OR l_tax > 0.07",
    "nested_bool": _L + "NOT (l_orderkey >= 300 OR NOT (l_quantity > 10 OR l_linenumber = 3))",
    "cast_no_skip": _L + "CAST(l_orderkey AS DOUBLE) < 100.5",
    "func_no_skip": _L + "abs(l_orderkey) < 100",
    "like_no_skip": "SELECT p_partkey FROM {part} WHERE p_name LIKE 'b%'",
    "is_null": "SELECT o_orderkey FROM {flagged} WHERE {maybe} IS NULL",
    "null_safe_eq": _L + "l_orderkey IS NOT DISTINCT FROM 77",
    "nested_field": "SELECT event_id FROM {nested} WHERE {s.v} > 90.0",
    "nested_deep": "SELECT event_id FROM {nested} WHERE {s.inner.kind} = 'click' AND {s.v} < 20.0",
    "partitioned": "SELECT event_id, event_type FROM {by_type} WHERE event_type = 'click' AND value > 50.0",
    "join_inner": "SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority FROM {shipped} l JOIN {dated} o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "join_left": "SELECT o.o_orderkey, l.l_linenumber FROM {dated} o LEFT JOIN {shipped} l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 45 WHERE o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "join_right": "SELECT o.o_orderkey, l.l_linenumber FROM {shipped} l RIGHT JOIN {dated} o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate < TIMESTAMP '1996-01-01 00:00:00' WHERE o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "join_full": "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM (SELECT o_orderkey FROM {orders} WHERE o_orderkey < 60) a FULL JOIN (SELECT o_orderkey FROM {orders} WHERE o_orderkey BETWEEN 40 AND 90) b ON a.o_orderkey = b.o_orderkey",
    "join_semi": "SELECT c_custkey FROM {customer} c WHERE c_acctbal > 8000.0 AND EXISTS (SELECT 1 FROM {dated} o WHERE o.o_custkey = c.c_custkey)",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE c_acctbal > 8000.0 AND NOT EXISTS (SELECT 1 FROM {dated} o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00')",
    "join_range": "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM {orders} a JOIN {orders} b ON b.o_orderkey > a.o_orderkey AND b.o_orderkey <= a.o_orderkey + 2 WHERE a.o_orderkey < 80 AND b.o_orderkey < 90",
    "join_three": "SELECT c.c_custkey, o.o_orderkey, l.l_linenumber FROM {customer} c JOIN {dated} o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE c.c_acctbal > 8000.0 AND o.o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "self_join": "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey WHERE a.l_orderkey < 100 AND b.l_orderkey > 50",
    "subquery_in": "SELECT o_orderkey FROM {orders} WHERE o_orderkey < 400 AND o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 48)",
    "subquery_exists": "SELECT o_orderkey FROM {dated} o WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND EXISTS (SELECT 1 FROM {shipped} l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate < TIMESTAMP '1996-06-30 00:00:00')",
    "subquery_scalar": "SELECT o_orderkey FROM {orders} WHERE o_orderkey < (SELECT min(l_orderkey) + 50 FROM {lineitem} WHERE l_orderkey > 100)",
    "cte_twice": "WITH c AS (SELECT * FROM {lineitem} WHERE l_orderkey < 120) SELECT x.l_orderkey, x.l_linenumber FROM c x JOIN c y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber",
    "agg_group": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM {shipped} WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_returnflag",
    "agg_having": "SELECT l_orderkey, count(*) AS n FROM {shipped} WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_orderkey HAVING count(*) > 5",
    "agg_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM {shipped} WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00'",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {shipped} WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {shipped} WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {shipped} WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "window_rank": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "window_rows": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "topk": "SELECT o_orderkey, o_totalprice FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sort_limit": "SELECT o_orderkey FROM {dated} WHERE o_orderdate > TIMESTAMP '2000-01-01 00:00:00' ORDER BY o_orderkey LIMIT 20",
    "union_all": "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 5 UNION ALL SELECT CAST(s_suppkey AS INT) AS k FROM {supplier} WHERE s_suppkey < 5",
    "union_distinct": "SELECT n_regionkey AS k FROM {nation} WHERE n_nationkey < 12 UNION SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 3",
    "intersect": "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 9 INTERSECT SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey > 4",
    "except": "SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 9 EXCEPT SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey > 4",
    "csv_scan": "SELECT n_nationkey, n_name FROM {nation_csv} WHERE n_nationkey < 6",
    "json_scan": "SELECT n_nationkey, n_name FROM {nation_json} WHERE n_nationkey < 6",
    "orc_scan": "SELECT n_nationkey, n_name FROM {nation_orc} WHERE n_nationkey < 6",
    "fn_string": "SELECT doc_id, upper(substr(source, 1, 3)) AS s, length(source) AS n, concat(lang, '-', source) AS ls FROM {documents} WHERE n_chars < 500",
    "fn_date": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "fn_math": "SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS f, o_orderkey % 7 AS r FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "fn_cast": "SELECT event_id, CAST(floor(value) AS BIGINT) AS v, CAST(event_id AS VARCHAR(20)) AS t FROM {tagged} WHERE value > 90.0",
    "fn_case": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, coalesce(o_orderpriority, '') AS p FROM {dated} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
}
#: Derived columns, as plain SQL for the other engine.
_DERIVED = {"as_short": "p_size", "as_byte": "p_size", "is_open": "(o_orderstatus = 'O')", "maybe": "(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)", "s.v": "value", "s.inner.kind": "event_type"}


def _fill(text: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        text = text.replace("{" + k + "}", v)
    return text


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ws = Workspace.of(spark, sf_dir)
        names = {k: ws.view(x) for k, x in _TABLES.items() if "{" + k + "}" in text}
        return ws.session.sql(_fill(text, names | {k: k for k in _DERIVED}))

    return run


# ---------------------------------------------------------------- life cycle
def _fresh(ws: Workspace, name: str, columns: tuple[str, ...] = ()):
    path = ws.fresh(Layout("events", ("event_id",), 6, columns=columns), name)
    return path, ws.session.dataset(path)


def _builder(dataset):
    return dataset.index_builder().add_min_max_index("event_id").add_bloom_filter_index("user_id", ndv=1000)


def _indexed_copy(ws: Workspace, name: str):
    path, dataset = _fresh(ws, name)
    _builder(dataset).build(ws.spark.read)
    return path, dataset


def _appended(ws: Workspace, name: str):
    """An indexed copy, and behind it the table once more with its ids moved, not indexed yet. The ids of the two may
    overlap, so each row has its batch."""
    path, dataset = _fresh(ws, name, ("0 AS batch",))
    _builder(dataset).add_min_max_index("batch").build(ws.spark.read)
    more = ws.read("events").withColumns({"event_id": F.col("event_id") + 1_000_000, "batch": F.lit(1)})
    ws.write(Layout("events", ("event_id",), 3), more, path, "append")
    return path, dataset


def _count(ws: Workspace, path: str, where: str) -> DataFrame:
    return ws.session.apply(ws.spark.read.parquet(path).where(where)).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def refresh_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table once more, with ids moved, is appended and indexed."""
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _appended(ws, "append")
    done = dataset.refresh_index(ws.spark.read).first()
    out = _count(ws, path, "batch = 1 AND event_id >= 1000100")
    return out.withColumns({"added": F.lit(done["new_entries_added"]), "removed": F.lit(done["old_entries_removed"])})


def stale_index_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't indexed yet are read."""
    ws = Workspace.of(spark, sf_dir)
    path, _ = _appended(ws, "stale")
    return _count(ws, path, "batch = 1 AND event_id >= 1000100")


def refresh_after_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data are overwritten: all old files go, all new ones are indexed."""
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "modify")
    ws.write(Layout("events", ("event_id",), 6), ws.read("events").withColumn("event_id", F.col("event_id") + 5), path, "overwrite")
    done = dataset.refresh_index(ws.spark.read).first()
    out = _count(ws, path, "event_id < 105")
    return out.withColumns({"added": F.lit(done["new_entries_added"]), "removed": F.lit(done["old_entries_removed"])})


def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "drop")
    dataset.drop_index()
    return _count(ws, path, "event_id < 100").withColumn("indexed", F.lit(dataset.is_indexed()))


def evaluation_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is read; the statistics say what would have been skipped."""
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "evaluation")
    ws.session.set(config.EVALUATION.key, "true")
    try:
        n = ws.session.apply(ws.spark.read.parquet(path).where("event_id < 100")).count()
    finally:
        ws.session.unset(config.EVALUATION.key)
    return dataset.latest_query_stats().select(F.lit(n).cast("long").alias("rows"), "isSkippable", "total_Objs", (F.col("skipped_Objs") > 0).alias("skips"))


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "stats")
    ws.session.apply(ws.spark.read.parquet(path).where("event_id < 0"))
    return dataset.latest_query_stats().select("status", "isSkippable", "skipped_Objs", "total_Objs")


def describe_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace.of(spark, sf_dir)
    _, dataset = _indexed_copy(ws, "describe")
    out = dataset.describe_index(ws.spark.read)
    return out.where("`Data Skipping Index Stats` IN ('Status', 'Number of objects indexed', 'Metadata version', 'minmax', 'bloomfilter')").select(F.col("`Data Skipping Index Stats`").alias("item"), "value")


def list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "list")
    return ws.session.list_indexes().where(F.col("Dataset") == dataset.table_identifier).select(F.col("`Index type`").alias("kind"), F.col("`Index columns`").alias("cols"))


def regex_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug-in index over the matches of a pattern: pages of the hosts whose first label is `blog`."""
    register_regex_plugin()
    ws = Workspace.of(spark, sf_dir)
    name = ws.view(PAGES)
    return ws.session.sql(f"SELECT page_id, url FROM {name} WHERE regexp_extract(url, '{HOST}', 1) = 'blog'")


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index keeps, folded over all files: it must be the table's own range and values."""
    ws = Workspace.of(spark, sf_dir)
    ws.view(LINEITEM)
    m = ws.session.dataset(ws.path(LINEITEM)).metadata()
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("l_returnflag_valuelist_12"))))
    return m.agg(F.min("l_orderkey_minmax_10.min").alias("lo"), F.max("l_orderkey_minmax_10.max").alias("hi"), F.array_join(flags, ",").alias("flags"))


def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays made, filtered, sorted and joined over a pruned scan."""
    ws = Workspace.of(spark, sf_dir)
    return ws.session.sql(f"SELECT event_id, array_join(array_sort(filter(array(event_id % 7, event_id % 5, event_id % 3), x -> x > 1)), '-') AS a, CAST(size(split(event_type, 'i')) AS BIGINT) AS n FROM {ws.view(TAGGED)} WHERE value > 90.0")


def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from JSON text over a pruned scan."""
    ws = Workspace.of(spark, sf_dir)
    return ws.session.sql(f"SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {ws.view(TAGGED)} WHERE value > 90.0")


def empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without rows are indexed, and skipped or read without harm."""
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "empty")
    for _ in range(2):
        ws.spark.read.parquet(path).limit(0).coalesce(1).write.mode("append").parquet(path)
    done = dataset.refresh_index(ws.spark.read).first()
    return _count(ws, path, "event_id < 100").withColumn("added", F.lit(done["new_entries_added"]))


def _at(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """An index whose place is given in one of the four ways."""
    ws = Workspace.of(spark, sf_dir)
    path = ws.fresh(Layout("events", ("event_id",), 6), "located")
    dataset = ws.session.dataset(path)
    db = f"wl_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{path}-db' WITH DBPROPERTIES ('{config.LOCATION.key}' = '{path}-base')")
    try:
        spark.sql(f"CREATE TABLE {db}.t (i int) USING parquet")
        where = {"EXPLICIT_LOCATION": f"{path}-exact", "HIVE_DB_NAME": db, "HIVE_TABLE_NAME": f"{db}.t"}[kind]
        dataset.set_params({config.LOCATION.key: where, config.LOCATION_TYPE.key: kind})
        dataset.index_builder().add_min_max_index("event_id").build(spark.read)
        ws.session.apply(spark.read.parquet(path).where("event_id < 100")).collect()
        skips = dataset.latest_query_stats().first()["skipped_Objs"] > 0
        return _count(ws, path, "event_id < 100").withColumn("skips", F.lit(skips))
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def location_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir, "EXPLICIT_LOCATION")


def location_of_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir, "HIVE_DB_NAME")


def location_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir, "HIVE_TABLE_NAME")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of many small files: a refresh folds them into as few as the bounds allow, one row per file."""
    ws = Workspace.of(spark, sf_dir)
    path, dataset = _indexed_copy(ws, "compact")
    rows = dataset.metadata()
    rows.repartition(5).write.mode("append").parquet(rows.inputFiles()[0].rsplit("/", 1)[0])  # twice over, in small files
    dataset.refresh_index(ws.spark.read)
    m = dataset.metadata()
    return m.agg(F.count("*").alias("n"), F.countDistinct("obj_name").alias("files")).withColumn("parts", F.lit(len(m.inputFiles())))


def older_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of versions 1 to 3: each is read as it is, then upgraded by a refresh."""
    ws = Workspace.of(spark, sf_dir)
    out = []
    for version in (1, 2, 3):
        path = ws.fresh(Layout("events", ("event_id",), 6), f"version{version}")
        dataset = ws.session.dataset(path)
        params = [] if version < 3 else {}
        rows = spark.read.parquet(path).groupBy(files.file_id().alias("obj_name")).agg(F.struct(F.min("event_id").alias("min"), F.max("event_id").alias("max")).alias("m"))
        named = F.col("obj_name").alias("obj_name", metadata={"version": version, "tableIdentifier": dataset.table_identifier})
        column = F.col("m").alias(versions.column_name(("event_id",), "minmax", version), metadata={"index": {"name": "minmax", "cols": ["event_id"], "params": params}})
        rows.select(named, column).write.parquet(dataset.handle.location())
        n = ws.session.apply(spark.read.parquet(path).where("event_id < 100")).count()
        before = (dataset.handle.version(), dataset.latest_query_stats().first()["skipped_Objs"] > 0)
        dataset.refresh_index(spark.read)
        ws.session.apply(spark.read.parquet(path).where("event_id < 100")).count()
        out.append((version, n, *before, dataset.handle.version(), dataset.latest_query_stats().first()["skipped_Objs"] > 0))
    return spark.createDataFrame(out, "version int, n long, read_as int, skips boolean, upgraded_to int, skips_then boolean")


_N = "CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids"
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "refresh_after_append": (refresh_after_append, "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id + 1000000) AS BIGINT) AS ids, 3 AS added, 0 AS removed FROM events WHERE event_id >= 100"),
    "refresh_after_modify": (refresh_after_modify, "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id + 5) AS BIGINT) AS ids, 6 AS added, 6 AS removed FROM events WHERE event_id < 100"),
    "stale_index_safe": (stale_index_safe, "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id + 1000000) AS BIGINT) AS ids FROM events WHERE event_id >= 100"),
    "drop_index": (drop_index, f"SELECT {_N}, false AS indexed FROM events WHERE event_id < 100"),
    "evaluation_mode": (evaluation_mode, "SELECT CAST(0 AS BIGINT) AS rows, true AS \"isSkippable\", CAST(6 AS BIGINT) AS \"total_Objs\", true AS skips"),
    "query_stats": (query_stats, "SELECT 'SUCCESS' AS status, true AS \"isSkippable\", CAST(6 AS BIGINT) AS \"skipped_Objs\", CAST(6 AS BIGINT) AS \"total_Objs\""),
    "describe_index": (describe_index, "SELECT * FROM (VALUES ('Status', 'Up to date'), ('Number of objects indexed', '6'), ('Metadata version', '4'), ('minmax', 'event_id'), ('bloomfilter', 'user_id')) t(item, value)"),
    "list_indexes": (list_indexes, "SELECT * FROM (VALUES ('minmax', 'event_id'), ('bloomfilter', 'user_id')) t(kind, cols)"),
    "regex_plugin": (regex_plugin, f"SELECT page_id, url FROM pages WHERE regexp_extract(url, '{HOST}', 1) = 'blog'"),
    "fn_array": (fn_array, "SELECT event_id, array_to_string(list_sort([x FOR x IN [event_id % 7, event_id % 5, event_id % 3] IF x > 1]), '-') AS a, CAST(len(string_split(event_type, 'i')) AS BIGINT) AS n FROM events WHERE value > 90.0"),
    "fn_json": (fn_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value > 90.0"),
    "empty_files": (empty_files, f"SELECT {_N}, 2 AS added FROM events WHERE event_id < 100"),
    "location_explicit": (location_explicit, f"SELECT {_N}, true AS skips FROM events WHERE event_id < 100"),
    "location_of_database": (location_of_database, f"SELECT {_N}, true AS skips FROM events WHERE event_id < 100"),
    "location_of_table": (location_of_table, f"SELECT {_N}, true AS skips FROM events WHERE event_id < 100"),
    "compacted": (compacted, "SELECT CAST(6 AS BIGINT) AS n, CAST(6 AS BIGINT) AS files, 1 AS parts"),
    "older_metadata": (older_metadata, "SELECT v AS version, CAST((SELECT count(*) FROM events WHERE event_id < 100) AS BIGINT) AS n, v AS read_as, true AS skips, 4 AS upgraded_to, true AS skips_then FROM (VALUES (1), (2), (3)) t(v)"),
    "metadata_rows": (metadata_rows, "SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(v) for k, v in SQL.items()} | {k: f for k, (f, _) in OTHER.items()}
ORACLE_SQL: dict[str, str] = {k: _fill(v, {t: x.table for t, x in _TABLES.items()} | _DERIVED) for k, v in SQL.items()} | {k: s for k, (_, s) in OTHER.items() if s}
