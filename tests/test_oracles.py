"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from kinweave.plans import catalog, oracles
from tools.check_oracles import TABLES, same_rows

CHOSEN = [
    "block_equality",
    "block_multirule",
    "block_name_similarity",
    "compare_levels",
    "multirule_links",
    "greedy_clusters",
    "top_links",
    "rank_candidates",
    "requery_candidates",
    "cluster_recall",
    "unrelated_merges",
    "in_batch_guard",
    "cluster_members",
    "resolve_incremental",
    "em_train",
    "request_errors",
    "process_requests",
    "rdf_property_path",
    "request_parse",
    "latency_summary",
    "growth_profile",
    "evaluate_variant",
    "model_files",
    "report_files",
    "stream_replay",
]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, small, database, name):
    found = entry_points.queries()[name](spark, small).toPandas()
    assert same_rows(found, database.execute(entry_points.oracle_sql()[name]).df()) == ""


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["mention_id", "cluster_id"]
