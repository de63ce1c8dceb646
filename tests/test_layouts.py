"""Copies of tables in files of about equal bytes, whatever the table's size and keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from winnowlake import queries
from winnowlake.sources.layouts import Workspace


def documents(spark, path, n, n_chars):
    rows = spark.range(n).selectExpr("id AS doc_id", f"CAST({n_chars} AS BIGINT) AS n_chars", "'en' AS lang", "'web' AS source")
    rows.withColumn("text", F.expr("repeat('x', CAST(n_chars AS INT))")).write.parquet(f"{path}/documents.parquet")
    return Workspace.of(spark, str(path))


@pytest.mark.parametrize("n_chars", ["IF(id % 50 = 0, 100000 + id, id % 1000)", "IF(id % 10 < 9, 2500, id)"], ids=["few long texts", "one frequent length"])
def test_files_of_a_large_copy_have_about_equal_bytes(spark, tmp_path, n_chars):
    """100 MB of text in 8 files: neither the long texts nor those of one length are all in one."""
    ws = documents(spark, tmp_path, 40_000, n_chars)
    df = ws.frame(queries.DOCUMENTS)
    found = [r[0] for r in df.groupBy(F.input_file_name()).agg(F.sum("n_chars")).select("sum(n_chars)").collect()]
    assert len(found) == 8
    assert max(found) < 1.6 * sum(found) / 8
    rows = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64(*sorted(x.columns)).cast("decimal(30)"))).first()
    assert rows(df) == rows(ws.read("documents"))


@pytest.mark.parametrize("weight", [0, 3000])
def test_ranges_of_odd_keys(spark, monkeypatch, weight):
    """Nulls, NaN, texts and times: all rows, in ranges one after the other, about as large as asked for."""
    from winnowlake.sources import ranges

    monkeypatch.setattr(ranges, "RANGE_BYTES", 20_000)
    df = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN DOUBLE('NaN') ELSE CAST(id * 7919 % 1000 AS DOUBLE) END AS x", "IF(id % 7 = 0, NULL, concat('s', id % 10)) AS s",
        "timestamp_seconds(id)::timestamp_ntz AS t", f"repeat('y', IF(id % 30 = 0, {weight}, 0)) AS y", "array(id) AS a", "named_struct('v', concat('', id)) AS n",
    )
    out = ranges.in_ranges(df, ("x", "s", "t"), 4).withColumn("p", F.spark_partition_id())
    got = out.collect()
    assert sorted(map(str, (r[:-1] for r in map(tuple, got)))) == sorted(map(str, map(tuple, df.collect())))
    assert [r["id"] for r in out.orderBy("x", "s", "t").select("id", "p").collect()] == [r["id"] for r in out.orderBy("p", "x", "s", "t").collect()]
    sizes = [r["b"] for r in out.groupBy("p").agg(F.sum(ranges.row_bytes(df)).alias("b")).collect()]
    assert len(sizes) > 10 and max(sizes) < 45_000


def test_joins_of_large_tables_are_filtered_before_the_shuffle(spark, tmp_path):
    """With filters that fit the keys of large tables; rows as by SQL, and a session's own settings stay."""
    import duckdb

    (tmp_path / "sf").symlink_to("/root/testdata/sf0.001")
    key = "spark.sql.optimizer.runtime.bloomFilter."
    s = spark.newSession()
    ws = Workspace(s, str(tmp_path / "sf"))
    assert s.conf.get(key + "applicationSideScanSizeThreshold") == "64MB"
    s.conf.set(key + "applicationSideScanSizeThreshold", "1b")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    Workspace._all[spark.sparkContext.applicationId, ws.sf_dir] = ws
    df = queries.QUERIES["join_three"](s, ws.sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "might_contain" in plan and "4000000, 67108864" in plan
    sql = queries.ORACLE_SQL["join_three"]
    for t in ("customer", "orders", "lineitem"):
        sql = sql.replace(f" {t} ", f" '{ws.sf_dir}/{t}.parquet' ")
    assert sorted(map(tuple, df.collect())) == sorted(duckdb.sql(sql).fetchall())
    Workspace(s, str(tmp_path / "sf"))
    assert s.conf.get(key + "applicationSideScanSizeThreshold") == "1b"
