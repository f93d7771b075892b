"""Tables and records of any shape, spans of every occurrence, and their fusion against brute force."""

import random
import re

from pyspark.sql import functions as F

from tracelink.functions import rules
from tracelink.operators import extraction as X
from tracelink.operators.findings import evidence
from tracelink.plans import QUERIES
from tracelink.sources import columns as C


def test_overlay_and_records(spark):
    base = spark.createDataFrame([(1, "a", float("nan"))], "id long, name string, score double")
    extra = spark.createDataFrame([("b", 2, "batch", 1.5)], "name string, id long, _import_id string, weight double")
    both = C.with_overlay(base, extra)
    assert both.columns == ["id", "name", "score", "_import_id", "weight"] and both.count() == 2
    got = {r.id: r.asDict() for r in C.records(both).collect()}
    assert got == {1: {"id": 1, "name": "a", "score": None, "weight": None}, 2: {"id": 2, "name": "b", "score": None, "weight": 1.5}}
    assert C.records(both, drop_internal=False).columns == both.columns


def test_upload_columns(spark):
    rows = spark.createDataFrame([(1, " x ", "nan", None, "1", "y", 0.5), (2, "NULL", " ", "", "2", "z", None)], "row_no long, ` name ` string, empty string, Unnamed_3 string, `a.b` string, `name` string, n double")
    got = C.clean_upload(rows, keep=("row_no",))
    assert got.columns == ["row_no", "name", "a.b", "n"] and [tuple(r) for r in got.orderBy("row_no").collect()] == [(1, "x", "1", 0.5), (2, None, "2", None)]
    samples = C.column_samples(got, "row_no", 1).collect()
    assert sorted(map(tuple, samples)) == [("a.b", 1, "1"), ("n", 1, "0.5"), ("name", 1, "x")]
    assert C.clean_upload(rows.limit(0), keep=("row_no",)).columns == ["row_no"] and C.column_samples(rows.select("row_no"), "row_no").count() == 0


def test_records_of_any_keys(spark):
    docs = [
        '{"FIR_ID": "F1", " Raw_Text ": " He ran. ", "Juris": "DEL", "date": "2026-01-02", "Officer": "Rao", "tags": ["a", 1], "metadata": {"event_date": "2026-03-03", "k": "v", "date": ""}}',
        '{"id": 7, "text": "x", "narrative": "y", "source": "wire"}', '{"text": "no reference"}', '{"fir": "F9", "text": " "}', "[1]", "{broken", None, '{"id": "a", "text": "t", "metadata": "x"}',
    ]
    got = C.narrative_records(spark.createDataFrame(list(enumerate(docs)), "n long, doc string")).orderBy("n").collect()
    assert [r.reason for r in got] == [None, None, "no reference", "no text", "not a record", "not a record", "not a record", "metadata is no object"]
    assert (got[0].source_ref, got[0].text, got[0].jurisdiction, got[0].source) == ("F1", " He ran. ", "DEL", "unstructured_fir")
    assert got[0].metadata == {"event_date": "2026-03-03", "k": "v", "date": "2026-01-02", "Officer": "Rao", "tags": '["a",1]'}
    assert (got[1].source_ref, got[1].text, got[1].jurisdiction, got[1].source, got[1].metadata) == ("7", "x", "UNSPECIFIED", "wire", {})


TEXTS = [
    "Complainant Asha Rao met Accused Ravi Kumar Das near New Delhi. A murderous theft; Theft again, robbery  event. Northern Bank and Northern Banking.",
    "See FIR No. 123 and FIR/DEL/2024/17 and fir12345; call 9876543210 or 9876543210 from DL11AB1234, IFSC hdfc0001234, account 123456789012 to ACC100004.", "", None, "no entity", "Suspect ACC100001 DL01A0001 called",
]


def found(text):
    out = []
    for kind, pattern in X.ENTITIES:
        out += [(kind, m[1], m.start(1), m.end(1)) for m in re.finditer(pattern, text or "")]
    return sorted(set(out))


def test_entities_at_every_place(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    got = {i: [] for i in range(len(TEXTS))}
    for r in rows.select("i", F.inline(X.entity_spans(F.col("text")))).collect():
        got[r.i].append((r.entity_type, r.value, r.starts, r.ends))
    assert {i: sorted(v) for i, v in got.items()} == {i: found(t) for i, t in enumerate(TEXTS)}
    assert not any(v == "murder" for v in (x[1] for x in got[0])) and ("organisation", "Northern Bank") in [x[:2] for x in got[0]] and sum(x[1].lower() == "theft" for x in got[0]) == 2


def test_identifiers_at_every_place(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    got = [(r.i, r.entity_type, r.value, r.starts, TEXTS[r.i][r.starts : r.ends] == r.raw) for r in rows.select("i", F.inline(X.identifier_spans(F.col("text")))).collect()]
    assert all(r[4] for r in got)
    # both phones: no word for a case within 32 characters
    assert sorted(r[1:3] for r in got if r[0] == 1) == [("bank_account", "123456789012"), ("bank_account", "ACC100004"), ("ifsc", "HDFC0001234"), ("phone", "+919876543210"), ("phone", "+919876543210"), ("vehicle", "DL11AB1234")]


def test_fields_of_records(spark):
    rows = spark.createDataFrame([("r1", "FIR no 9876543210", " 9876543210 ", "123456789", "123456789", "9876543210")], "record_id string, text string, phone string, bank_account string, notes string, source_ref string")
    got = sorted((r.field, r.entity_type, r.value, r.starts) for r in X.record_mentions(rows).collect())
    assert got == [("bank_account", "bank_account", "123456789", 0), ("phone", "phone", "+919876543210", 0)]


def test_fusion_against_all_pairs(spark):
    rng = random.Random(3)
    span = lambda: (f"d{rng.randrange(4)}", *(lambda a: (a, a + rng.randrange(1, 9)))(rng.randrange(60)))
    entities, identifiers = [(*span(), f"e{i}") for i in range(80)], [span() for _ in range(25)]
    got = X.fused(spark.createDataFrame(entities, "source_ref string, starts int, ends int, value string"), spark.createDataFrame(identifiers, "source_ref string, starts int, ends int")).collect()
    assert sorted(map(tuple, got)) == sorted(e for e in entities if not any(i[0] == e[0] and i[1] < e[2] and e[1] < i[2] for i in identifiers))


def test_findings(spark):
    from tracelink.operators.findings import evidence, findings

    rows = [("F1", "DEL", "call 9876543210 on 02-01-2026", {}), ("F1", "DEL", "call 9876543210 on 02-01-2026", {}), ("F2", "MUM", "call +91-98765-43210", {"event_date": "01/03/2026", "event_end": "soon"}), ("F3", "DEL", "98765 and 9876543210", None)]
    rows += [("F4", " ", "9876543210", {}), ("", "DEL", "9876543210", {}), ("F5", "DEL", "DL11AB1234", {}), ("F6", "DEL", "dl11ab1234", {}), ("F7", "DEL", "DL11AB1234", {}), ("F8", "DEL", None, {})]
    records = spark.createDataFrame(rows, "source_ref string, jurisdiction string, text string, metadata map<string,string>")
    registry = spark.createDataFrame([("phone", "+919876543210", "P1")], "entity_type string, value string, entity_id string")
    told = evidence(records, registry).cache()
    assert told.count() == 6
    (one,) = findings(told).collect()
    assert (one.finding_id, one.cases, one.jurisdictions, one.observations, one.confidence, one.matched_entity_ids) == ("AN-2:phone:+919876543210", 3, 2, 3, 1.0, ["P1"])
    assert (one.valid_from, one.valid_to, len(one.limits)) == ("2026-01-02", "soon", 3)
    assert {r.value: r.confidence for r in findings(told, 3, 1).collect()} == {"+919876543210": 1.0, "DL11AB1234": 0.0}
    assert findings(told.limit(0)).count() == 0


def test_places_extract_once(spark):
    texts = [None, "", "no number", "call 9876543210", "9876543210 9876543210, é 6123456789", "+91-90000-12345x+9190000123459876543210"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = r"(?:\+91[-\s]?\d{5}[-\s]?\d{5}|\b[6-9]\d{9}\b)"
    at = rules.places(F.col("text"), pattern)
    want = [None if t is None else [(m.group(), m.start()) for m in re.finditer(pattern, t)] for t in texts]
    assert [None if r.x is None else [tuple(p) for p in r.x] for r in rows.select(at.alias("x")).collect()] == want
    plan = rows.select(at.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_frequent_identifiers_are_dealt_and_reviews_meet_no_lists(spark):
    records = spark.createDataFrame([(f"r{i}", "DEL", f"paid via HDFC0001234, plate DL01AB{i:04}", None) for i in range(30)], "source_ref string, jurisdiction string, text string, metadata map<string,string>")
    registry = spark.createDataFrame([("vehicle", "DL01AB0003", "P1"), ("vehicle", "DL01AB0003", "P2"), ("ifsc", "HDFC0001234", "P1")], "entity_type string, value string, entity_id string")
    rows = evidence(records, registry)
    assert "line_of_key" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.status for r in rows.where("entity_type = 'ifsc'").collect()} == {"resolved"} and rows.where("status = 'ambiguous'").count() == 1 and rows.count() == 60
    plan = QUERIES["i25_relevant_reviews"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


def test_narrative_records_read_each_record_once(spark):
    docs = spark.createDataFrame([(1, '{"ID": "F1", "Text": "a", "id": "F2", "metadata": {"x": "1", "date": ""}, "Date": " d ", "X": "2", "y": "3"}'), (2, "no json"), (3, None)], "ord int, doc string")
    told = C.narrative_records(docs)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2  # the record and its metadata
    rows = {r.ord: r for r in told.collect()}
    assert rows[1].source_ref == "F2" and rows[1].text == "a" and rows[1].metadata == {"x": "1", "date": "d", "y": "3"} and rows[1].reason is None
    assert {rows[2].reason, rows[3].reason} == {"not a record"}


def test_resolved_deals_frequent_identifiers_and_imports_deal_rows_without_a_case(spark):
    from tracelink.operators import resolved
    from tracelink.streaming.imports import import_rows

    told = spark.createDataFrame([("F1", "X", "d", t, v) for t, v in (("phone", "1"), ("phone", "2"), ("ifsc", "3"), ("vehicle", "4"))], "source_ref string, jurisdiction string, event_date string, entity_type string, value string")
    registry = spark.createDataFrame([("phone", "1", "P1"), ("phone", "2", "P1"), ("phone", "2", "P2")], "entity_type string, value string, entity_id string")
    out = resolved(told, registry)
    assert "line_of_key" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.value: (r.owners, r.status, r.entity_id, float(r.confidence)) for r in out.collect()} == {"1": (1, "resolved", "P1", 1.0), "2": (2, "ambiguous", None, 1.0), "3": (None, "unresolved", None, 0.0), "4": (None, "unresolved", None, 0.0)}
    rows = spark.createDataFrame([("F1", "a"), (None, "b"), (None, "c")], "fir_id string, name string")
    made = import_rows(rows, spark.createDataFrame([("F1",)], "fir_id string"), admin=True)
    assert "line_of_key" in made._jdf.queryExecution().optimizedPlan().toString() and {r.name: r.status == "duplicate" for r in made.collect()} == {"a": True, "b": False, "c": False}
