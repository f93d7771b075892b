"""Row checks, duplicates, disposition, fan-out and the streamed import on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tracelink.operators import imports as I
from tracelink.streaming.imports import import_rows, run_imports

UPLOAD = "n long, case_id string, name string, mobile string, place string, date string, text string, weapon string"
FIELDS = {"case_id": "fir_id", "name": "name", "mobile": "phone", "place": "jurisdiction", "date": "date", "text": "narrative_text"}
ROWS = [
    (0, "FIR1", "Ravi Rao", "98765 43210", "New Delhi", "03/04/2026", None, "knife"),
    (1, " FIR1", "Ravi Rao ", "+91-98765-43210", "DELHI", "2026-04-03", None, None),  # the same in another spelling
    (2, None, "nan", None, "Delhi", None, None, "x"),  # nothing to tell it by
    (3, "FIR3", "Asha", "12345", "Delhi", "2026-02-30", None, None),  # phone and date are none
    (4, "FIR4", "Asha", None, "Mumbai", None, None, None),  # not allowed
    (5, None, None, None, None, None, "He ran.", None),  # a narrative without a place
    (6, "FIR6", "Mira", None, None, None, None, None),  # no place
    (7, "FIR9", "Lata", None, "Delhi", "soon", None, None),  # stored case, bad date
    (8, None, "ANIL KUMAR", None, "Delhi", None, None, None),  # stored name
    (9, None, "Someone New", "9000000009", "Delhi", None, None, None),  # stored phone
    (10, None, "nan", "", "Delhi", None, None, "y"),  # the same as row 2
    (11, "FIR3", "Asha", "12345", "Delhi", None, None, None),  # row 3 again: invalid rows are no duplicates
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = I.split_row(spark.createDataFrame(ROWS, UPLOAD).repartition(3), FIELDS, "n")
    cases = spark.createDataFrame([("FIR9",), (None,)], "fir_id string")
    persons = spark.createDataFrame([("P1", "Anil Kumar", "+91-90000-00001"), ("P2", "Bela", "9000000009"), ("P3", None, None)], "person_id string, name string, phone string")
    return rows, cases, persons


def test_row_checks(tables):
    got = {r.n: r for r in I.checked(tables[0], jurisdictions=("DEL",)).collect()}
    assert [got[n].status for n in range(12)] == ["ready", "ready", "incomplete", "invalid", "unauthorized", "incomplete", "incomplete", "incomplete", "ready", "ready", "incomplete", "invalid"]
    assert (got[0].phone, got[0].date, got[0].jurisdiction, got[0].unmapped) == ("+919876543210", "2026-04-03", "DEL", {"weapon": "knife"})
    assert got[3].phone is None and got[3].date is None and got[3].unmapped == {"phone_original": "12345", "date_original": "2026-02-30"} and len(got[3].reasons) == 2
    assert got[4].reasons == ["This record belongs to a jurisdiction outside your current access."] and got[7].unmapped == {"date_original": "soon"}
    assert {r.n: r.status for r in I.checked(tables[0], admin=True).collect() if r.n in (4, 5, 6)} == {4: "ready", 5: "incomplete", 6: "ready"}


@pytest.mark.parametrize("run", [100_000, 4])
def test_assessment(spark, tables, monkeypatch, run):
    monkeypatch.setattr(I, "RUN", run)
    rows, cases, persons = tables
    left_out = spark.createDataFrame([(9,)], "n long")
    got = {r.n: r for r in I.assess(rows, "n", cases, persons, jurisdictions=("DEL",), skipped=left_out).collect()}
    assert len(got) == len(ROWS)
    assert {n: r.earlier_row for n, r in got.items() if r.earlier_row is not None} == {1: 0, 5: 2, 10: 2}  # rows without any identity are copies of each other
    assert got[1].status == "duplicate" and "row 1 in this file" in got[1].reasons[0] and got[11].status == "invalid"
    assert got[7].status == "duplicate" and got[7].disposition == "unresolved"
    assert (got[8].status, got[8].possible_match, got[8].match_method, got[8].match_confidence, got[8].disposition) == ("possible_duplicate", "P1", "exact_name", 0.95, "import")
    assert (got[9].possible_match, got[9].match_method, got[9].status, got[9].importable) == ("P2", "exact_phone", "skipped", False)
    assert [got[n].importable for n in range(8)] == [True, False, False, True, False, False, False, False]
    assert got[4].redacted and got[4].person_key is None and got[0].person_key == "IMP-0000" and got[11].person_key == "IMP-0003" and got[2].person_key is None
    seen = {r.n: r for r in I.shown(I.assess(rows, "n", cases, persons, jurisdictions=("DEL",)), "n").collect()}
    assert seen[4].name is None and seen[4].unmapped is None and seen[4].status == "unauthorized" and seen[0].name == "Ravi Rao"
    total = I.summary(I.assess(rows, "n", cases, persons, jurisdictions=("DEL",))).head()
    assert (total.detected, total.ready, total.duplicates, total.possible_duplicates, total.unauthorized, total.invalid, total.blocking_unauthorized) == (12, 1, 4, 2, 1, 2, True)


def test_names_go_through_the_cascade(spark, tables):
    rows, cases, persons = tables
    registry = spark.createDataFrame([], "entity_type string, value string, entity_id string")
    told = rows.withColumn("name", F.when(F.col("n") == 8, F.lit("Kumar")).otherwise(F.col("name")))
    got = {r.n: r for r in I.assess(told, "n", cases, persons, admin=True, registry=registry).collect()}
    assert (got[8].status, got[8].match_method, got[8].possible_match) == ("possible_duplicate", "fuzzy_name", "P1") and got[0].status == "ready"


def test_earlier_row_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(I, "RUN", 7)
    rng = random.Random(6)
    rows = [(i, rng.choice("abc"), rng.choice(["ready", "ready", "incomplete", "invalid", "unauthorized"])) for i in range(120)]
    table = spark.createDataFrame(rows, "n long, name string, status string").withColumns({c: F.lit(None).cast("string") for c in I.HASHED if c != "name"})
    seen, want = {}, {}
    for i, name, status in rows:
        if name in seen and status in I.OPEN:
            want[i] = seen[name]
        else:
            want[i], seen[name] = None, i
    assert {r.n: r.earlier_row for r in I.in_file_duplicates(table, "n").collect()} == want


def test_fan_out(tables):
    rows, cases, persons = tables
    assessed = I.assess(rows, "n", cases, persons, admin=True)
    out = {k: v.collect() for k, v in I.fan_out(assessed, "n", "abcdefghij", with_warnings=True).items()}
    ids = {r.person_id: r for r in out["persons"]}
    assert "IMP-abcdefgh-0000" in ids and ids["IMP-abcdefgh-0000"].phone == "+919876543210" and all(r._import_id == "abcdefghij" for r in out["persons"])
    assert {(r.fir_id, r.person_id) for r in out["fir"]} >= {("FIR1", "IMP-abcdefgh-0000"), ("FIR3", "IMP-abcdefgh-0003")}
    kinds = sorted(r.entity_type for r in out["entity_mapping"] if r.entity_id == "IMP-abcdefgh-0000")
    assert kinds == ["person", "phone"] and len(ids) == len(out["persons"]) and not out["vehicles"]
    assert not any(x.collect() for x in I.fan_out(assessed.limit(0), "n", "abcdefghij").values())


def test_stream_of_three_files_with_restarts(spark, tmp_path):
    rng = random.Random(9)
    made = [(f"FIR{rng.randrange(40)}", rng.choice(["Asha", "Ravi", None, " "]), rng.choice(["9876543210", "bad", None]), "Delhi", rng.choice(["2026-01-02", "soon"])) for _ in range(300)]
    schema = "fir_id string, name string, phone string, jurisdiction string, date string"
    existing = spark.createDataFrame([("FIR3",), ("FIR4",)], "fir_id string")
    folder, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    keep = lambda d: sorted(tuple(map(str, r)) for r in d.select("content_hash", "fir_id", "name", "phone", "date", "status", "disposition").collect())
    options = {"jurisdictions": ("DEL",)}
    for k in range(3):  # a new stream each time, as after a restart
        spark.createDataFrame(made[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(folder)
        run_imports(spark, folder, schema, existing, target, log, **options)
        so_far = import_rows(spark.createDataFrame(made[: 100 * k + 100], schema), existing, **options)
        assert keep(spark.read.parquet(target)) == keep(so_far)
    run_imports(spark, folder, schema, existing, target, log, **options)  # nothing new
    assert keep(spark.read.parquet(target)) == keep(so_far)
    assert {r.disposition for r in spark.read.parquet(target).select("disposition").distinct().collect()} == {"import", "unresolved"}


def test_late_rows_leave_the_state(spark):
    rows = spark.createDataFrame([("FIR1", "2026-01-01"), ("FIR1", "2026-01-01"), ("FIR2", "2026-01-05")], "fir_id string, seen string").withColumn("seen", F.col("seen").cast("timestamp"))
    with pytest.raises(Exception, match="(?i)watermark|batch"):
        import_rows(rows, spark.createDataFrame([], "fir_id string"), seen_at="seen", late="2 days").collect()


def test_recurrence_over_three_batches(spark, tmp_path):
    """Counts after each batch equal those over all orders so far; a new stream goes on where the last has ended."""
    from tracelink import streaming
    from tracelink.operators import bound
    from tracelink.operators.catalog import OPERATORS
    from tracelink.sources import TABLES

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    folder, mentions, found, log = (str(tmp_path / x) for x in ("orders", "mentions", "findings", "log"))
    for k in range(3):
        orders.where(f"o_orderkey % 3 = {k}").coalesce(1).write.mode("append").parquet(folder)
        streaming.run_available(spark, folder, streaming.recurrence(sf, mentions, found), log)
        given = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLES} | {"orders": orders.where(f"o_orderkey % 3 <= {k}")}
        want = {(r.entity_type, r.value, r.cases, r.jurisdictions) for r in bound(spark, sf, OPERATORS["g10_recurrence"], given).collect()}
        last = spark.read.parquet(found).groupBy("entity_type", "value").agg(F.max_by(F.struct("cases", "jurisdictions"), "number").alias("c"))
        assert {(r.entity_type, r.value, r.c.cases, r.c.jurisdictions) for r in last.where("c.cases >= 3 and c.jurisdictions >= 2").collect()} == want
    assert want


def test_rows_are_stored_once_over_three_files(spark, tmp_path):
    from tracelink.streaming import store_new

    folder, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    rows, stored_rows = [(i % 7, None if i % 5 == 0 else "x") for i in range(40)], set()
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 20], "a long, b string").coalesce(1).write.mode("append").parquet(folder)
        store_new(spark, folder, ["a", "b"], target, log)
        stored_rows |= set(rows[10 * k : 10 * k + 20])
        got = [(r.a, r.b) for r in spark.read.parquet(target).collect()]
        assert len(got) == len(set(got)) and set(got) == stored_rows


def test_rows_without_a_key_are_dealt_in_every_join(tables):
    rows, cases, persons = tables
    plan = I.assess(rows, "n", cases, persons, jurisdictions=("DEL",))._jdf.queryExecution().optimizedPlan().toString()
    assert all(any(k in line and "line_of_key" in line for line in plan.split("\n") if "Join LeftOuter" in line) for k in ("fir_id", "person_id", "phone", "name_key", "person_group"))


def test_an_import_carries_only_what_its_sources_take(tables, monkeypatch):
    """The rows that fan out are written without reasons and hashes, and what leads to them does not make them either."""
    wrote, write = {}, I.stored
    monkeypatch.setattr(I, "stored", lambda df, name: wrote.update({name: df}) or write(df, name))
    rows, cases, persons = tables
    assessed = I.assess(rows, "n", cases, persons, jurisdictions=("DEL",))
    assert [r.identity for r in assessed.orderBy("n").collect()] == [r.i for r in I.checked(rows, jurisdictions=("DEL",)).orderBy("n").select(I.identity_hash().alias("i")).collect()]
    I.fan_out(assessed, "n", "abcdefghij", with_warnings=True)
    taken = wrote["import-taken"]
    assert set(wrote) == {"import-rows", "import-taken", "import-persons"} and not {"reasons", "unmapped", "identity"} & set(taken.columns)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "Exact duplicate of row" not in plan


def test_dates_are_tried_only_in_formats_whose_sign_they_hold(spark):
    from tracelink.functions import rules

    told = ["3-4-2026", "31/12/2025", "12/31/2025", "3.4.2026", "2026/4/3", "3 Apr 2026", "3 April 2026", "2026-04-03", "2026-02-30", "unknown", "", " 3/4/2026 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "n int, t string")
    plain = F.when(F.trim("t").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date(trim(t), 'yyyy-MM-dd')")).otherwise(F.coalesce(*[F.expr(f"try_to_date(trim(t), '{f}')") for f in rules.IMPORT_DATES]))
    got = rows.select("n", rules.import_date(F.col("t")).alias("a"), plain.alias("b")).orderBy("n").collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) == 9
    plan = rows.select(rules.import_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") >= len(rules.IMPORT_DATES)
