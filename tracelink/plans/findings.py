"""Queries of recurring identifiers over the narratives, with oracles written for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.operators import bound, oracle
from tracelink.operators.findings import LIMITS, UNDATED, evidence, findings


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    rows = bound(spark, sf_dir, "SELECT source_ref, jurisdiction, text, CASE WHEN ord % 4 = 0 THEN map('event_date', event_date, 'event_end', CASE WHEN ord % 8 = 0 THEN '2030-01-01' END) END AS metadata FROM {narratives}", made)
    return evidence(rows, bound(spark, sf_dir, "SELECT entity_type, value, entity_id FROM {registry}", made))


def g11_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


def g12_finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(_evidence(spark, sf_dir))
    return found.withColumns({"limits": F.array_join("limits", " "), "matched_entity_ids": F.array_join("matched_entity_ids", ",")})


def i25_relevant_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ambiguous identifiers that the registry knows: made different before they meet it, so that no mention meets all owners."""
    made: dict[str, DataFrame] = {}
    asked = bound(spark, sf_dir, "SELECT DISTINCT entity_type, value FROM {resolved} WHERE status = 'ambiguous'", made)
    return asked.join(bound(spark, sf_dir, "SELECT entity_type, value FROM {registry}", made).hint("merge"), ["entity_type", "value"], "left_semi")


QUERIES = {f.__name__: f for f in (g11_evidence_rows, g12_finding_rows, i25_relevant_reviews)}

_FROM = "CASE WHEN n.ord % 4 = 0 THEN n.event_date WHEN n.ord % 3 = 0 THEN n.event_date END"
_EVIDENCE = f"""
    SELECT m.source_ref, m.jurisdiction, sha256(n.text) AS content_hash, m.entity_type, m.value, CASE WHEN m.entity_type = 'ifsc' THEN 'HDFC0001234' WHEN m.entity_type = 'vehicle' THEN CASE WHEN n.ord % 4 = 0 THEN lower(m.value) ELSE m.value END
           WHEN m.entity_type = 'phone' THEN CASE WHEN n.ord % 7 = 1 THEN right(m.value, 10) ELSE '+91-' || substr(m.value, 4, 5) || '-' || right(m.value, 5) END ELSE m.value END AS raw,
           CASE WHEN o.owners = 1 THEN 'resolved' WHEN o.owners > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN o.owners = 1 THEN o.one END AS matched_entity_id, CAST(CASE WHEN o.owners IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence,
           {_FROM} AS valid_from, CASE WHEN n.ord % 8 = 0 THEN '2030-01-01' END AS valid_to
    FROM {{mentions}} m JOIN {{narratives}} n ON n.source_ref = m.source_ref LEFT JOIN (SELECT entity_type, value, count(DISTINCT entity_id) AS owners, min(entity_id) AS one FROM {{registry}} GROUP BY 1, 2) o ON o.entity_type = m.entity_type AND o.value = m.value"""
_TEMPLATES = {
    "g11_evidence_rows": _EVIDENCE,
    "g12_finding_rows": f"""
        SELECT 'AN-2:' || entity_type || ':' || value AS finding_id, entity_type, value, 'The ' || entity_type || ' identifier ' || value || ' recurs across ' || CAST(cases AS VARCHAR) || ' distinct cases in ' || CAST(jurisdictions AS VARCHAR) || ' jurisdictions.' AS claim,
               cases, jurisdictions, observations, confidence, '{" ".join(LIMITS)}' || CASE WHEN undated > 0 THEN ' {UNDATED}' ELSE '' END AS limits, coalesce(matched, '') AS matched_entity_ids, valid_from, valid_to
        FROM (SELECT entity_type, value, count(DISTINCT source_ref) AS cases, count(DISTINCT jurisdiction) AS jurisdictions, count(*) AS observations, min(confidence) AS confidence, count_if(valid_from IS NULL) AS undated, max(matched_entity_id) AS matched,
                     min(least(valid_from, valid_to)) AS valid_from, max(greatest(valid_from, valid_to)) AS valid_to
              FROM ({_EVIDENCE}) e GROUP BY 1, 2) g
        WHERE cases >= 3 AND jurisdictions >= 2""",
}
ORACLE_SQL = {name: oracle(t) for name, t in _TEMPLATES.items()}
