"""Queries of the single-value rules over the domain views, each with an oracle written for itself in the other engine's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import rules
from tracelink.functions.headers import header_mapping
from tracelink.operators import bound, oracle
from tracelink.operators.extraction import fused, record_mentions

Query = Callable[[SparkSession, str], DataFrame]


def _over(view: str, *columns: Callable[[], Column | str]) -> Query:
    """Columns over one domain view. They are built when the query runs, since Columns need a session."""
    return lambda spark, sf_dir: bound(spark, sf_dir, f"SELECT * FROM {{{view}}}").select(*[c() for c in columns])


def _named(name: str) -> Callable[[], str]:
    return lambda: name


def b13_temporal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = bound(spark, sf_dir, "SELECT * FROM {dated_notes}")
    metadata = F.create_map(F.lit("event_date"), "m_event_date", F.lit("valid_from"), "m_valid_from", F.lit("event_end"), "m_event_end")
    return notes.select("source_ref", rules.temporal_bounds(metadata, {"date": F.col("date")}, F.col("text")).alias("b")).select("source_ref", "b.*")


def _mentions(of: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: bound(spark, sf_dir, "SELECT * FROM {prose}").select("source_ref", F.inline(of(F.col("text")))).withColumnRenamed("start", "starts")


QUERIES: dict[str, Query] = {
    "b7_phone_valid": _over("phone_spellings", _named("row_no"), lambda: rules.phone_valid(F.col("phone")).alias("valid")),
    "b8_jurisdiction_code": _over("place_spellings", _named("row_no"), lambda: rules.jurisdiction_code(F.col("place")).alias("code")),
    "b10_import_date": _over("date_spellings", _named("row_no"), lambda: F.date_format(rules.import_date(F.col("spelt")), "yyyy-MM-dd").alias("date"), lambda: rules.import_date(F.col("spelt")).isNotNull().alias("parsed")),
    "b11_finding_date": _over("date_spellings", _named("row_no"), lambda: rules.finding_date(F.col("spelt")).alias("date")),
    "b12_case_timestamp": _over("time_spellings", _named("row_no"), lambda: F.date_format(rules.case_timestamp(F.col("spelt")), "yyyy-MM-dd HH:mm:ss").alias("sort_ts")),
    "b13_temporal_bounds": b13_temporal_bounds,
    "c1_phone_mentions": _mentions(rules.phone_mentions),
    "c3_account_mentions": _mentions(rules.account_mentions),
    "c7_span_confidence": _over("model_spans", _named("row_no"), lambda: rules.span_confidence(F.col("label"), F.col("starts"), F.col("ends")).alias("confidence"), lambda: rules.eligible(rules.span_confidence(F.col("label"), F.col("starts"), F.col("ends"))).alias("eligible")),
}


def h2_header_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_mapping(bound(spark, sf_dir, "SELECT * FROM {headers}"))


def c8_span_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of statements that no identifier overlaps."""
    statements: dict[str, DataFrame] = {}
    entities = bound(spark, sf_dir, "SELECT * FROM {ner_spans}", statements)
    return fused(entities, bound(spark, sf_dir, "SELECT * FROM {identifier_spans}", statements)).select("source_ref", "kind", "value", "starts")


def c5_field_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every column of the persons and of the narratives' text."""
    persons = bound(spark, sf_dir, "SELECT person_id AS record_id, name, phone, vehicle_no, bank_account, social_id, home_city, risk_group FROM {persons}")
    prose = bound(spark, sf_dir, "SELECT source_ref AS record_id, text, jurisdiction FROM {narratives}")
    return record_mentions(persons).unionAll(record_mentions(prose)).groupBy("field", "entity_type").agg(F.count("*").alias("mentions"), F.count_distinct("value").alias("different"))


QUERIES |= {f.__name__: f for f in (h2_header_fuzzy, c8_span_fusion, c5_field_mentions)}


def _first_date(text: str, formats: tuple[str, ...]) -> str:
    return f"coalesce({', '.join(f'CAST(try_strptime({text}, {f!r}) AS DATE)' for f in formats)})"


_FINDING = ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y")
_IMPORT = ("%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y", "%Y/%m/%d", "%m/%d/%Y", "%d %b %Y", "%d %B %Y")
_FOUND = f"CASE WHEN trim({{0}}) = '' THEN NULL ELSE coalesce(strftime({_first_date('trim({0})', _FINDING)}, '%Y-%m-%d'), trim({{0}})) END"
_PLACES = ", ".join(f"('{a}', '{b}')" for a, b in rules.JURISDICTIONS.items())
#: Matches of a pattern with their places: the texts between matches and the matches before add up.
_SPANS = """
    SELECT source_ref, text, found[k] AS value,
           CAST(coalesce(list_sum(list_transform(between[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS starts
    FROM (SELECT source_ref, text, found, between, unnest(range(1, len(found) + 1)) AS k
          FROM (SELECT source_ref, text, regexp_extract_all(text, '{0}') AS found, regexp_split_to_array(text, '{0}') AS between FROM {{{{prose}}}}) a) b"""

_TEMPLATES = {
    "b7_phone_valid": "SELECT row_no, regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^([0-9]{{10}}|91[0-9]{{10,}})$') AS valid FROM {phone_spellings}",
    "b8_jurisdiction_code": f"""
        SELECT p.row_no, CASE WHEN lower(trim(p.place)) IN ('', 'nan', 'none', 'null') THEN NULL
                              ELSE coalesce(max(a.code) FILTER (a.spelling = lower(trim(p.place))), max(a.code), CASE WHEN length(trim(p.place)) < 6 THEN upper(trim(p.place)) ELSE trim(p.place) END) END AS code
        FROM {{place_spellings}} p LEFT JOIN (VALUES {_PLACES}) a(spelling, code) ON a.spelling = lower(trim(p.place)) OR a.spelling = regexp_replace(lower(trim(p.place)), '[^a-z0-9]', '', 'g')
        GROUP BY p.row_no, p.place""",
    "b10_import_date": f"SELECT row_no, strftime(d, '%Y-%m-%d') AS date, d IS NOT NULL AS parsed FROM (SELECT row_no, CASE WHEN regexp_full_match(trim(spelt), '[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}') THEN try_cast(trim(spelt) AS DATE) ELSE {_first_date('trim(spelt)', _IMPORT)} END AS d FROM {{date_spellings}}) q",
    "b11_finding_date": f"SELECT row_no, {_FOUND.format('spelt')} AS date FROM {{date_spellings}}",
    "b12_case_timestamp": "SELECT row_no, CASE WHEN regexp_matches(trim(spelt), '(Z|[+]05:30)$') THEN strftime(try_cast(trim(spelt) AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') ELSE strftime(try_cast(trim(spelt) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS sort_ts FROM {time_spellings}",
    "b13_temporal_bounds": f"""
        SELECT source_ref, {_FOUND.format("coalesce(nullif(m_event_date, ''), nullif(m_valid_from, ''), nullif(date, ''), nullif(regexp_extract(text, '(?i)\\b(?:dated|on|occurred)[ ]+([0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), ''))")} AS valid_from, {_FOUND.format("nullif(m_event_end, '')")} AS valid_to
        FROM {{dated_notes}}""",
    "c1_phone_mentions": "SELECT source_ref, '+91' || right(regexp_replace(value, '[^0-9]', '', 'g'), 10) AS value, starts FROM (" + _SPANS.format(r"(?:\+91[-\s]?\d{{5}}[-\s]?\d{{5}}|\+91[-\s]?\d{{10}}|\b[6-9]\d{{9}}\b)").replace("{{prose}}", "{prose}") + r") s WHERE NOT regexp_matches(right(left(text, starts), 32), '(?i)\b(?:case|fir|crime|dated|date|no\.?|number|ref)\b') AND NOT regexp_matches(right(left(text, starts), 1) || '.' || substr(text, starts + length(value) + 1, 1), '[0-9]')",
    "c3_account_mentions": "SELECT source_ref, upper(value) AS value, starts FROM (" + _SPANS.format(r"(?i)\bACC\d{{6,}}\b").replace("{{prose}}", "{prose}") + ") s UNION ALL SELECT source_ref, value, starts FROM (" + _SPANS.format(r"\b\d{{9,18}}\b").replace("{{prose}}", "{prose}") + r") s WHERE regexp_matches(right(left(text, starts), 48), '(?i)\b(?:account|a/c|acct|bank\s+account)\b')",
    "c5_field_mentions": """
        SELECT field, entity_type, count(*) AS mentions, count(DISTINCT value) AS different FROM (
          SELECT 'phone' AS field, 'phone' AS entity_type, replace(phone, '-', '') AS value FROM {persons}
          UNION ALL SELECT 'vehicle_no', 'vehicle', vehicle_no FROM {persons} UNION ALL SELECT 'bank_account', 'bank_account', bank_account FROM {persons}
          UNION ALL SELECT 'text', entity_type, value FROM {mentions}) m GROUP BY ALL""",
    "c8_span_fusion": "SELECT s.source_ref, s.kind, s.value, s.starts FROM {ner_spans} s WHERE NOT EXISTS (SELECT 1 FROM {identifier_spans} i WHERE i.source_ref = s.source_ref AND i.starts < s.ends AND s.starts < i.ends)",
    "c7_span_confidence": """
        SELECT row_no, c AS confidence, c >= .85 AS eligible
        FROM (SELECT row_no, round(CASE label WHEN 'PERSON' THEN .97 WHEN 'ORG' THEN .93 WHEN 'GPE' THEN .91 WHEN 'LOC' THEN .91 WHEN 'FAC' THEN .88 WHEN 'EVENT' THEN .86 ELSE .85 END - CASE WHEN ends < starts + 4 THEN .02 ELSE 0 END, 4) AS c FROM {model_spans}) q""",
}

ORACLE_SQL = {name: oracle(template) for name, template in _TEMPLATES.items()}
