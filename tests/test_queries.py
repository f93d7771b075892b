"""Registered link-analysis queries against DuckDB at the smallest scale, and operators on hand-made frames."""

import duckdb
import pytest

import __spark_entry__ as entry
from tracelink.operators import apply
from tracelink.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["a16_contract_export", "b5_phone", "b9_crime_canonical", "d12_shared_identifiers", "e2_edges", "f1_degree_centrality", "g7_anomaly_profile", "g10_recurrence", "h11_validation_summary", "i17_strongest_neighbours", "a5_overlay_append", "b17_metadata_redaction", "h1_header_alias", "h3_mapping_override", "i27_report_row"]


def flat(rows):
    return sorted(tuple("" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_oracle(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) q").fetchall()
    assert flat(mine.select(*columns).collect()) == flat(theirs)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recurrence_needs_three_cases_and_two_jurisdictions(spark):
    rows = [("a", "DEL", "phone", "1"), ("b", "MUM", "phone", "1"), ("c", "BLR", "phone", "1"), ("c", "BLR", "phone", "1"), ("a", "DEL", "phone", "2"), ("b", "DEL", "phone", "2"), ("c", "DEL", "phone", "2")]
    mentions = spark.createDataFrame(rows, "source_ref string, jurisdiction string, entity_type string, value string")
    assert apply(spark, "g10_recurrence", mentions=mentions).collect() == [("phone", "1", 3, 3)]


def test_empty_input_gives_no_findings(spark):
    empty = spark.createDataFrame([], "source_ref string, jurisdiction string, entity_type string, value string")
    assert apply(spark, "g10_recurrence", mentions=empty).count() == 0
