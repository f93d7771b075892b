"""Golden values of the single-value rules, header matching, extraction and projected communities."""

import pytest
from pyspark.sql import functions as F

import tracelink.plans.graph as graph
from tracelink.functions import headers, rules
from tracelink.operators import apply


def each(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(2)
    return [r.out for r in rows.select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()]


def test_phones_codes_and_dates(spark):
    assert each(spark, ["+91-90000-10001", "9000010001", "+91 9000010001", "12345", "0919000010001", "not-a-phone", None], rules.phone_valid) == [True, True, True, False, False, False, None]
    assert each(spark, ["New Delhi", "BOMBAY", "ban-galore", "goa", "Lucknow", "nan", " ", None], rules.jurisdiction_code) == ["DEL", "MUM", "BLR", "GOA", "Lucknow", None, None, None]
    iso = lambda c: F.date_format(rules.import_date(c), "yyyy-MM-dd")
    assert each(spark, ["2026-01-02", "2026-02-30", "03/04/2026", "3-4-2026", "3.4.2026", "2026/4/3", "12/25/2026", "3 Apr 2026", "soon", None], iso) == ["2026-01-02", None, *["2026-04-03"] * 4, "2026-12-25", "2026-04-03", None, None]
    assert each(spark, ["2026-1-2", "02-01-2026", "02/01/2026", "12/25/2026", " soon ", "", None], rules.finding_date) == ["2026-01-02"] * 3 + ["2026-12-25", "soon", None, None]
    told = lambda c: F.date_format(rules.case_timestamp(c), "yyyy-MM-dd HH:mm")
    assert each(spark, ["2026-01-01T10:00:00Z", "2026-01-01T10:00:00+05:30", "2026-01-01", "nan", "x"], told) == ["2026-01-01 10:00", "2026-01-01 04:30", "2026-01-01 00:00", None, None]


def test_temporal_bounds_order(spark):
    rows = [({"event_date": "02/01/2026", "event_end": "2026-02-01"}, "2020-01-01", "dated 3-3-2020"), ({"event_date": ""}, "2026-01-05", "x"), (None, None, "It occurred 08-09-2026 there"), ({}, None, "on 2026-03-04."), ({}, "", "none")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m map<string,string>, date string, text string")
    got = table.select("i", rules.temporal_bounds(F.col("m"), {"date": F.col("date")}, F.col("text")).alias("b")).orderBy("i").collect()
    assert [(r.b.valid_from, r.b.valid_to) for r in got] == [("2026-01-02", "2026-02-01"), ("2026-01-05", None), ("2026-09-08", None), ("2026-03-04", None), (None, None)]


def test_mentions_in_prose(spark):
    pairs = lambda found: [[(x.value, x.start) for x in row] for row in found]
    phones = each(spark, ["Contact +91-90000-10001 for details", "Case No. 9876543210 was registered on 08-09-2026", "call 9876543210", "number 9876543210", "x98765432101", ""], rules.phone_mentions)
    assert pairs(phones) == [[("+919000010001", 8)], [], [("+919876543210", 5)], [], [], []]
    accounts = each(spark, ["Reference number 123456789012 noted", "from account 123456789012 to ACC100004.", "acc100001", "a/c 999999999", None], rules.account_mentions)
    assert pairs(accounts[:2]) == [[], [("ACC100004", 29), ("123456789012", 13)]] and accounts[4] is None
    assert pairs(accounts[2:4]) == [[("ACC100001", 0)], [("999999999", 4)]]


def test_span_confidence(spark):
    rows = spark.createDataFrame([("PERSON", 0, 11), ("GPE", 0, 2), ("ODD", 0, 9), ("EVENT", 3, 6)], "label string, a int, b int")
    got = rows.select(rules.span_confidence(F.col("label"), F.col("a"), F.col("b")).alias("c")).select("c", rules.eligible(F.col("c")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(0.97, True), (0.89, True), (0.85, True), (0.84, False)]


def test_header_matching(spark):
    golden = ["Case Number", "Suspect Name", "Mobile No.", "District", "Vehicle Registration", "Incident Date", "Officer", "Weapon", "Notes"]
    assert [x[2] for x in headers.match(golden)] == ["fir_id", "name", "phone", "jurisdiction", "vehicle_no", "date", None, None, None]
    assert [x[2:4] for x in headers.match(["fir_id", "a/c", "accused_id", "FIR No", "Vehicle Registraton", "", "Number phone"])] == [("fir_id", "alias"), ("bank_account", "alias"), ("person_id", "alias"), (None, "none"), ("vehicle_no", "fuzzy"), (None, "none"), ("phone", "fuzzy")]
    assert headers.likeness("registration vehicle", "vehicle registration") == 100 and headers.likeness("abc", "") == 0
    rows = [(f, p, h) for f in (1, 2) for p, h in enumerate(golden, 1)]
    got = headers.header_mapping(spark.createDataFrame(rows[::-1], "file_id long, pos long, header string")).where("file_id = 2").orderBy("pos").collect()
    assert [(r.pos, r.header, r.field) for r in got] == [(p, h, x[2]) for p, h, x in zip(range(1, 10), golden, headers.match(golden))]



def test_anomaly_reasons_and_rejections(spark):
    rows = [("P1", 30, 0.4, 0.45, 0.0, 0.0), ("P2", 24, 0.9, 0.0, 0.0, 0.0), ("P3", 60, 0.6, 0.2, 0.5, 0.1)]
    got = apply(spark, "g7_anomaly_profile", anomaly=spark.createDataFrame(rows, "person_id string, anomaly_score long, s1 double, s2 double, s3 double, s4 double")).orderBy("person_id").collect()
    assert [(r.band, r.reasons) for r in got] == [("ELEVATED", "transfers "), ("NORMAL", ""), ("HIGH", "communications social ")]
    resolved = spark.createDataFrame([("F1", "DEL", "phone", "+919000010099", "ambiguous", 2), ("F2", "MUM", "phone", "+919000010099", "ambiguous", 2), ("F3", "DEL", "phone", "1", "resolved", 1)], "source_ref string, jurisdiction string, entity_type string, value string, status string, owners long")
    reviews = spark.createDataFrame([("phone", "+919000010099", "DEL", "exact", "rejected")], "entity_type string, value string, jurisdiction string, method string, status string")
    guarded = apply(spark, "d6_rejection_guard", resolved=resolved, reviews=reviews).orderBy("source_ref").collect()
    assert [(r.status, r.note) for r in guarded] == [("unresolved", "rejected by a reviewer"), ("ambiguous", None), ("resolved", None)]
    assert [r.jurisdiction for r in apply(spark, "d9_review_queue", resolved=resolved, reviews=reviews).collect()] == ["MUM"]


def test_projected_communities(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    pairs = ["ab", "bc", "ca", "de", "ef", "fd", "cd"]
    edges = spark.createDataFrame([(x[0], x[1], "CALLED", f"2026-01-0{i + 1} 00:00:00") for i, x in enumerate(pairs * 1)] + [("b", "a", "CALLED", None)], "source string, target string, relationship string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    found = {r.id: (r.community, r.size, r.display_id) for r in graph.projected_communities(nodes, edges).collect()}
    assert found["a"] == found["b"] == found["c"] == ("a", 3, 1) and found["d"] == found["e"] == found["f"] == ("d", 3, 2) and found["g"] == ("g", 1, 3)
    early = {r.id: r.size for r in graph.projected_communities(nodes, edges, end="2026-01-03").collect()}
    assert early["a"] == 3 and early["d"] == 1
    with pytest.raises(ValueError):
        graph.projected_communities(nodes, edges, "2026-02-01", "2026-01-01")


def test_parameters_and_risk(spark):
    audit = spark.createDataFrame([(1, "J1"), (2, "J7"), (3, None)], "event_id long, jurisdiction string")
    ids = lambda params: sorted(r.event_id for r in apply(spark, "i20_jurisdiction_filter", params, audit=audit).collect())
    assert ids(None) == [1] and ids({"jurisdictions": ["J7", "J8"]}) == [2] and ids({"admin": True}) == [1, 2, 3]
    cases = spark.createDataFrame([("FIR9", "Theft", "P1")], "fir_id string, crime string, person_id string")
    persons = spark.createDataFrame([("P1", "A B")], "person_id string, name string")
    assert [r.name for r in apply(spark, "i3_case_detail", {"case_id": "FIR9"}, cases=cases, persons=persons).collect()] == ["A B"]
    with pytest.raises(ValueError):
        apply(spark, "i3_case_detail", {"nothing": 1}, cases=cases, persons=persons)
    rows = [("P1", 12, 6, 10, 3, 6, 0.5, 0.2), ("P2", 1, 0, 0, 1, 0, 0.0125, 0.0126), ("P3", 0, 0, 0, 0, 0, 0.0, 0.0)]
    inputs = spark.createDataFrame(rows, "person_id string, communications long, transfers long, social long, cases long, surveillance long, betweenness double, pagerank double")
    got = apply(spark, "g2_risk_score", risk_inputs=inputs).orderBy("person_id").collect()
    assert [(r.risk_score, r.band) for r in got] == [(100, "CRITICAL"), (15, "LOW"), (0, "LOW")]
