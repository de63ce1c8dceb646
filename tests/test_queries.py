"""Every registered query of the skipping engine against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from winnowlake import queries
from winnowlake.sources.layouts import Workspace, count_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


#: Queries that no file can be ruled out for: their predicate is no range or value of an index or holds in all
#: files, or they look at metadata only.
NO_SKIP = {
    "cast_no_skip", "func_no_skip", "like_no_skip", "or_unindexed", "is_null", "null_safe_eq", "minmax_ne", "vlist_inset", "vlist_not_in_null",
    "compacted", "describe_index", "drop_index", "list_indexes", "metadata_rows",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    session = Workspace.of(spark, SF).session
    session.clear_stats()
    df = queries.QUERIES[name](spark, SF)
    assert (session.latest_query_aggregated_stats().first()["skipped_Objs"] > 0) == (name not in NO_SKIP)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = lambda columns, found: sorted(str([r[list(columns).index(c)] for c in order]) for r in found)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["refresh_after_append", "stale_index_safe"])
def test_ids_that_overlap_those_appended(spark, tmp_path, name):
    """Ids beyond a million: rows of the table itself are in the range that is asked for among those appended."""
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id * 2500 AS event_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = duckdb.sql(queries.ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet'"))
    assert [tuple(r) for r in df.select(*want.columns).collect()] == want.fetchall()


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_files_are_really_left_out(spark):
    ws = Workspace.of(spark, SF)
    name = ws.view(queries.SHIPPED)
    where = "l_shipdate < TIMESTAMP '1996-01-01 00:00:00'"
    assert count_files(ws.session.sql(f"SELECT * FROM {name} WHERE {where}")) <= 4 < count_files(spark.table(name))


def test_entry_point_without_the_llm_folders(tmp_path):
    """A copy of the repository without them imports, and has the other queries."""
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "winnowlake", tmp_path / "winnowlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))]


def test_entry_point_with_llm_folders_that_do_not_import(tmp_path):
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "winnowlake", tmp_path / "winnowlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "winnowlake" / "llm").mkdir()
    (tmp_path / "winnowlake" / "llm" / "__init__.py").touch()
    (tmp_path / "winnowlake" / "llm" / "queries.py").write_text("import no_such_module")
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(queries.QUERIES))]
