"""The registry: every query builds, and key queries agree with their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check_queries import TABLES, rows_of

SOME = ["flagship_stratified_midrank", "A1_clip_rollup", "A6_regional_reach", "A21_paired_effect_split", "W5_place_midrank_split",
        "V3_search_grid", "V5_distinctive_by_case", "U1_stream_sync", "U2_rescore_stale", "M9_temporal_split", "S4_csv_union_by_name", "C22_settle_reply"]


@pytest.fixture(scope="module")
def sql(tables):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 130


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, tables, sql, name):
    df = entry_point.queries()[name](spark, tables)
    cursor = sql.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(columns, cursor.fetchall()) and got


def test_no_plan_pairs_everything_with_everything(spark, tables):
    for name in ("A6_regional_reach", "J9_resolve_place", "J12_name_leaks", "A24_one_vs_rest", "A27_term_effect", "V5_distinctive_by_case"):
        plan = entry_point.queries()[name](spark, tables)._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
