"""Registered queries of the link-analysis operators: each template over the domain views of sf_dir, and its oracle."""

from tracelink import streaming
from tracelink.operators import bound, oracle
from tracelink.operators.catalog import OPERATORS
from tracelink.plans import findings, graph, names, property_graph, rules, shapes
from tracelink.sources import files

QUERIES = {name: (lambda spark, sf_dir, t=template: bound(spark, sf_dir, t)) for name, template in OPERATORS.items()} | graph.QUERIES
QUERIES |= {"j1_incremental_ingest": streaming.j1_incremental_ingest, "j2_incremental_recurrence": streaming.j2_incremental_recurrence}
ORACLE_SQL = {name: oracle(template) for name, template in OPERATORS.items()} | graph.ORACLE_SQL
ORACLE_SQL |= {"j1_incremental_ingest": oracle("SELECT DISTINCT user_id, props, event_type FROM {events}"), "j2_incremental_recurrence": ORACLE_SQL["g10_recurrence"]}
QUERIES |= files.QUERIES
ORACLE_SQL |= {name: oracle(template) for name, template in files.ORACLE.items()}
QUERIES |= rules.QUERIES
ORACLE_SQL |= rules.ORACLE_SQL
QUERIES |= names.QUERIES | property_graph.QUERIES | shapes.QUERIES | findings.QUERIES
ORACLE_SQL |= property_graph.ORACLE_SQL | shapes.ORACLE_SQL | findings.ORACLE_SQL | names.ORACLE_SQL
