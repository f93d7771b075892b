"""Queries of tables of any shape, of narrative records and of imports over the domain views, with oracles written for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import scratch, stored
from tracelink.operators import bound, oracle
from tracelink.operators.imports import assess, fan_out, split_row, summary
from tracelink.sources import _IMPORTED
from tracelink.sources.columns import clean_upload, column_samples, narrative_records, records, with_overlay
from tracelink.streaming.imports import run_imports

OVERLAY = "SELECT 'IMP-' || person_id AS person_id, name, phone, 'batch' || CAST(ord % 3 AS STRING) AS _import_id FROM {persons} WHERE ord % 13 = 0"
#: An upload with headers and cells as people write them.
SHEET = """SELECT row_no, fir_id AS ` Case_No `, name AS `Suspect`, phone AS `Mobile`, date AS `Incident_Date`, jurisdiction AS `District`, CASE WHEN row_no % 5 = 0 THEN 'n/k' WHEN row_no % 5 = 1 THEN 'None' END AS `Officer`,
           '  ' AS `Remarks`, CAST(NULL AS STRING) AS `Blank`, 'x' AS `Unnamed_7` FROM {uploads}"""
FIELDS = {"Case_No": "fir_id", "Suspect": "name", "Mobile": "phone", "Incident_Date": "date", "District": "jurisdiction"}
ALLOWED = tuple(f"NATION_{i}" for i in range(25) if i % 6 != 5)
#: Spellings of a record's reference, text and place.
_SHAPES = (("FIR_ID", "Raw_Text", "Juris"), ("source_ref", "text", "jurisdiction"), ("case_ref", " Narrative ", "State"), ("id", "fir_text", "district"))


def a2_overlay_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_overlay(bound(spark, sf_dir, "SELECT person_id, name, home_city FROM {persons}"), bound(spark, sf_dir, OVERLAY))


def a3_overlaid_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as its loader gives it: base and overlay rows, without internal columns."""
    return records(a2_overlay_union(spark, sf_dir))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_upload(bound(spark, sf_dir, SHEET), keep=("row_no",))


def a9_upload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir)


def a10_all_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_samples(_sheet(spark, sf_dir), "row_no")


def a12_narrative_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four spellings, some without a text or a reference, one row each with its reason."""
    rows = bound(spark, sf_dir, "SELECT source_ref, text, jurisdiction, event_date, ord FROM {narratives}")
    text = F.when(F.col("ord") % 10 == 9, F.lit(" ")).otherwise(F.col("text"))
    ref = F.when(F.col("ord") % 11 == 10, F.lit("")).otherwise(F.col("source_ref"))
    made = [F.to_json(F.struct(ref.alias(a), text.alias(b), F.col("jurisdiction").alias(c), F.col("event_date").alias("Date"), F.lit("Rao").alias("Officer"))) for a, b, c in _SHAPES]
    doc = F.when(F.col("ord") % 4 == 0, made[0]).when(F.col("ord") % 4 == 1, made[1]).when(F.col("ord") % 4 == 2, made[2]).otherwise(made[3])
    told = narrative_records(rows.select("ord", doc.alias("doc")))
    return told.select("ord", "source", "source_ref", "text", "jurisdiction", "reason", F.col("metadata")["date"].alias("date"), F.col("metadata")["Officer"].alias("officer"), F.col("metadata")["district"].alias("district"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[str, DataFrame] = {}
    rows = split_row(_sheet(spark, sf_dir), FIELDS, "row_no")
    cases = bound(spark, sf_dir, "SELECT fir_id FROM {cases}", made)
    persons = bound(spark, sf_dir, "SELECT person_id, name, phone FROM {persons} UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), c_name, CAST(NULL AS STRING) FROM {customer} WHERE c_custkey % 10 = 0", made)
    return assess(rows, "row_no", cases, persons, jurisdictions=tuple(a.upper() if len(a) <= 5 else a for a in ALLOWED))


def h5_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the uploads with its verdict."""
    told = _assessed(spark, sf_dir)
    return told.select("row_no", "status", F.size("reasons").cast("long").alias("reasons"), "earlier_row", "possible_match", "match_method", "importable", "disposition", "redacted", "person_key", F.col("unmapped")["Officer"].alias("officer"), F.col("unmapped")["phone_original"].alias("phone_original"))


def h11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_assessed(spark, sf_dir))


def h13_added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the import adds to the four sources."""
    out = fan_out(_assessed(spark, sf_dir), "row_no", "batch-of-uploads", with_warnings=True)
    row = lambda source, *columns: out[source].select(F.lit(source).alias("source"), *[F.col(c).alias(n) for c, n in zip(columns, ("id", "person_id", "value"))])
    return row("persons", "person_id", "person_id", "name").unionAll(row("fir", "fir_id", "person_id", "date")).unionAll(row("entity_mapping", "source_id", "entity_id", "entity_type"))


def j1_import_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads as three files that a stream takes one by one, each different row stored once; the last comes
    after the stream has ended and begun anew, and one of its files has come before."""
    folder, target, log = scratch(spark, "uploads"), scratch(spark, "imported"), scratch(spark, "imports-log")
    rows = stored(bound(spark, sf_dir, "SELECT fir_id, name, phone, date, jurisdiction, row_no % 3 AS part FROM {uploads}"), "uploads-told")
    existing = stored(bound(spark, sf_dir, "SELECT DISTINCT fir_id FROM {cases}"), "cases-stored")
    schema = "fir_id string, name string, phone string, date string, jurisdiction string"
    for parts in ((0, 1), (2, 0)):
        for part in parts:
            rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
        run_imports(spark, folder, schema, existing, target, log, files_each=4, jurisdictions=ALLOWED)
    return spark.read.parquet(target).select("fir_id", "name", "phone", "date", "jurisdiction", "status", "disposition")


QUERIES = {f.__name__: f for f in (a2_overlay_union, a3_overlaid_persons, a9_upload_columns, a10_all_samples, a12_narrative_records, h5_assessment, h11_summary, h13_added_rows, j1_import_stream)}

_CLEAN = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim({0}) END"
_SHEET = f"""SELECT row_no, {_CLEAN.format('fir_id')} AS fir_id, {_CLEAN.format('name')} AS name, {_CLEAN.format('phone')} AS phone, {_CLEAN.format('date')} AS date, {_CLEAN.format('jurisdiction')} AS jurisdiction,
             CASE WHEN row_no % 5 = 0 THEN 'n/k' END AS officer FROM {{uploads}}"""
_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_ALLOWED = ", ".join(f"'{a}'" for a in ALLOWED)
_OPEN = "base IN ('ready', 'incomplete')"
_OK_DATE = _IMPORTED.format("date")
#: From the cleaned rows: values, the status by the row alone, and what tells rows apart.
_BASE = f"""
    SELECT *, CASE WHEN jurisdiction IS NOT NULL AND jurisdiction NOT IN ({_ALLOWED}) THEN 'unauthorized' WHEN jurisdiction IS NULL OR fir_id IS NULL AND name IS NULL AND phone IS NULL THEN 'incomplete' WHEN bad_phone THEN 'invalid' WHEN bad_date THEN 'incomplete' ELSE 'ready' END AS base,
           coalesce(strftime(day, '%Y-%m-%d'), '') || '|' || coalesce(fir_id, '') || '|' || coalesce(name, '') || '|' || coalesce(good_phone, '') AS identity
    FROM (SELECT *, phone IS NOT NULL AND good_phone IS NULL AS bad_phone, date IS NOT NULL AND day IS NULL AS bad_date
          FROM (SELECT *, CASE WHEN length({_DIGITS}) = 10 OR length({_DIGITS}) >= 12 AND substr({_DIGITS}, 1, 2) = '91' THEN '+91' || right({_DIGITS}, 10) END AS good_phone, {_OK_DATE} AS day FROM ({_SHEET}) s) v) w"""
_VERDICT = f"""
    SELECT *, CASE WHEN earlier_row IS NOT NULL OR stored AND base <> 'unauthorized' THEN 'duplicate' WHEN {_OPEN} AND owner IS NOT NULL THEN 'possible_duplicate' ELSE base END AS status
    FROM (SELECT b.*, CASE WHEN row_no > first AND {_OPEN} THEN greatest(first, coalesce(held, first)) END AS earlier_row, k.fir_id IS NOT NULL AS stored, coalesce(po.person_id, pn.person_id) AS owner, po.person_id AS phone_owner
          FROM (SELECT *, min(row_no) OVER (PARTITION BY identity) AS first, max(CASE WHEN NOT {_OPEN} THEN row_no END) OVER (PARTITION BY identity ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ({_BASE}) x) b
          LEFT JOIN (SELECT DISTINCT fir_id FROM {{cases}}) k ON b.fir_id = k.fir_id
          LEFT JOIN (SELECT replace(phone, '-', '') AS phone, min(person_id) AS person_id FROM {{persons}} GROUP BY 1) po ON b.good_phone = po.phone
          LEFT JOIN (SELECT lower(name) AS name, min(person_id) AS person_id FROM (SELECT person_id, name FROM {{persons}} UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), c_name FROM {{customer}} WHERE c_custkey % 10 = 0) p GROUP BY 1) pn ON lower(b.name) = pn.name) d"""
_MINE = f"status IN ({', '.join(repr(s) for s in ('ready', 'incomplete', 'possible_duplicate', 'invalid', 'duplicate'))})"
_HAS = "(fir_id IS NOT NULL OR name IS NOT NULL OR good_phone IS NOT NULL)"
_GROUP = "lower(coalesce(name, '')) || '|' || coalesce(good_phone, '')"
_FULL = f"""
    SELECT *, CASE status WHEN 'ready' THEN true WHEN 'possible_duplicate' THEN true WHEN 'incomplete' THEN {_HAS} AND jurisdiction IS NOT NULL WHEN 'invalid' THEN {_HAS} ELSE false END AS importable,
           CASE WHEN status IN ('ready', 'possible_duplicate') THEN 'import' ELSE 'unresolved' END AS disposition, status = 'unauthorized' AS redacted,
           CASE WHEN status <> 'unauthorized' AND {_GROUP} <> '|' THEN min(CASE WHEN status <> 'unauthorized' THEN row_no END) OVER (PARTITION BY {_GROUP}, status = 'unauthorized') END AS k
    FROM ({_VERDICT}) q"""
_KEY = "CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END"
_TAKEN = f"""
    SELECT *, 'IMP-batch-of-' || coalesce({_KEY}, CASE WHEN row_no < 10000 THEN lpad(CAST(row_no AS VARCHAR), 4, '0') ELSE left(CAST(row_no AS VARCHAR), 4) END) AS of_person FROM ({_FULL}) f
    WHERE disposition = 'import' OR importable AND status IN ('incomplete', 'invalid')"""
_PEOPLE = f"SELECT of_person, arg_min(name, row_no) FILTER (row_no = r) AS name, arg_min(good_phone, row_no) FILTER (row_no = r) AS phone FROM (SELECT *, min(row_no) OVER (PARTITION BY of_person) AS r FROM ({_TAKEN}) t) t GROUP BY of_person"
_REF, _TEXT = "CASE WHEN ord % 11 = 10 THEN NULL ELSE source_ref END", "CASE WHEN ord % 10 = 9 THEN NULL ELSE text END"

_TEMPLATES = {
    "a2_overlay_union": "SELECT person_id, name, home_city, NULL AS phone, NULL AS _import_id FROM {persons} UNION ALL SELECT 'IMP-' || person_id, name, NULL, phone, 'batch' || CAST(ord % 3 AS STRING) FROM {persons} WHERE ord % 13 = 0",
    "a3_overlaid_persons": "SELECT person_id, name, home_city, NULL AS phone FROM {persons} UNION ALL SELECT 'IMP-' || person_id, name, NULL, phone FROM {persons} WHERE ord % 13 = 0",
    "a9_upload_columns": f'SELECT row_no, fir_id AS "Case_No", name AS "Suspect", phone AS "Mobile", date AS "Incident_Date", jurisdiction AS "District", officer AS "Officer" FROM ({_SHEET}) s',
    "a10_all_samples": "SELECT field, CAST(n AS INTEGER) AS n, value FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY row_no) AS n FROM (" + " UNION ALL ".join(f"SELECT row_no, '{f}' AS field, {c} AS value FROM ({_SHEET}) s" for f, c in (("Case_No", "fir_id"), ("Suspect", "name"), ("Mobile", "phone"), ("Incident_Date", "date"), ("District", "jurisdiction"), ("Officer", "officer"))) + ") l WHERE value IS NOT NULL) r WHERE n <= 3",
    "a12_narrative_records": f"SELECT ord, 'unstructured_fir' AS source, {_REF} AS source_ref, {_TEXT} AS text, CASE WHEN ord % 4 = 3 THEN 'UNSPECIFIED' ELSE jurisdiction END AS jurisdiction, CASE WHEN ord % 11 = 10 THEN 'no reference' WHEN ord % 10 = 9 THEN 'no text' END AS reason, event_date AS date, 'Rao' AS officer, CASE WHEN ord % 4 = 3 THEN jurisdiction END AS district FROM {{narratives}}",
    "h5_assessment": f"""
        SELECT row_no, status, CASE WHEN base = 'unauthorized' THEN 1 ELSE CAST(fir_id IS NULL AND name IS NULL AND phone IS NULL AS BIGINT) + CAST(bad_phone AS BIGINT) + CAST(bad_date AS BIGINT) + CAST(jurisdiction IS NULL AS BIGINT) + CAST(earlier_row IS NOT NULL AS BIGINT) + CAST(stored AS BIGINT) + CAST(status = 'possible_duplicate' AS BIGINT) END AS reasons,
               earlier_row, CASE WHEN status = 'possible_duplicate' THEN owner END AS possible_match, CASE WHEN status = 'possible_duplicate' THEN CASE WHEN phone_owner IS NOT NULL THEN 'exact_phone' ELSE 'exact_name' END END AS match_method,
               importable, disposition, redacted, 'IMP-' || {_KEY} AS person_key, officer, CASE WHEN bad_phone THEN phone END AS phone_original
        FROM ({_FULL}) f""",
    "h11_summary": f"SELECT count(*) AS detected, count_if(status = 'ready') AS ready, count_if(status = 'incomplete') AS incomplete, count_if(status = 'invalid') AS invalid, count_if(status = 'duplicate') AS duplicates, count_if(status = 'possible_duplicate') AS possible_duplicates, count_if(status = 'unauthorized') AS unauthorized, 0 AS skipped, count_if(status = 'unauthorized') > 0 AS blocking_unauthorized, count_if(disposition = 'unresolved') > 0 AS blocking_unresolved, count_if(status IN ('incomplete', 'possible_duplicate', 'invalid')) > 0 AS can_continue_with_warnings FROM ({_FULL}) f",
    "h13_added_rows": f"WITH t AS ({_TAKEN}), p AS ({_PEOPLE}) SELECT 'persons' AS source, of_person AS id, of_person AS person_id, coalesce(name, of_person) AS value FROM p UNION ALL SELECT 'fir', fir_id, of_person, strftime(day, '%Y-%m-%d') FROM t WHERE fir_id IS NOT NULL UNION ALL SELECT 'entity_mapping', of_person, of_person, 'person' FROM p UNION ALL SELECT 'entity_mapping', phone, of_person, 'phone' FROM p WHERE phone IS NOT NULL",
    "j1_import_stream": f"""
        SELECT fir_id, name, good_phone AS phone, strftime(day, '%Y-%m-%d') AS date, jurisdiction, status, CASE status WHEN 'ready' THEN 'import' ELSE 'unresolved' END AS disposition
        FROM (SELECT b.*, CASE WHEN k.fir_id IS NOT NULL AND base <> 'unauthorized' THEN 'duplicate' ELSE base END AS status
              FROM (SELECT DISTINCT fir_id, name, good_phone, day, jurisdiction, base, phone, date FROM ({_BASE}) x) b LEFT JOIN (SELECT DISTINCT fir_id FROM {{cases}}) k ON b.fir_id = k.fir_id) s""",
}
ORACLE_SQL = {name: oracle(t) for name, t in _TEMPLATES.items()}
