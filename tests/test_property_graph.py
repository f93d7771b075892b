"""The declarative graph on small sources, its checks, and the stored graph that takes batches by key."""

from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.test_queries import SF, flat
from tracelink import functions
from tracelink.operators import property_graph as G
from tracelink.plans import property_graph as plans
from tracelink.sources import graph_store as S
from tracelink.sources.files import append_overlay


@pytest.fixture(scope="module")
def sources(spark):
    make = spark.createDataFrame
    return {
        "persons": make([(1, "P1", "Asha", "+91-98765-43210", "dl 11 ab1", "acc1", " u1 ", "Delhi", None), (2, "P2", "Ravi", "9876543210", None, None, None, None, "x"), (3, None, "No id", "1", None, None, None, None, None)], "ord long, person_id string, name string, phone string, vehicle_no string, bank_account string, social_id string, home_city string, risk_group string"),
        "cdr": make([(1, "P1", "P9", "2026-01-01", 5, "9876543210", None), (2, None, "P1", "2026-01-02", 6, "9876543210", "9876543211")], "ord long, caller_id string, receiver_id string, timestamp string, duration_sec long, caller_phone string, receiver_phone string"),
        "fir": make([(1, "F1", "P1", " Theft ", "2026-01-03", "Delhi"), (2, None, "P1", "Theft", None, "Delhi"), (3, "F2", "P2", None, None, None)], "ord long, fir_id string, person_id string, crime string, date string, location string"),
        "social": make([(1, "P1", "P2", "reply", "2026-01-01"), (2, "P1", "P2", None, None), (3, "P1", None, "reply", None)], "ord long, user_id string, connected_user_id string, interaction_type string, date string"),
        "surveillance": make([(1, "S1", "P1", "Delhi", "2026-01-01", "meeting", "DL11AB1"), (2, "S2", "P1", " ", None, None, None)], "ord long, event_id string, person_id string, location string, timestamp string, event_type string, vehicle_no string"),
    }


@pytest.fixture(scope="module")
def rows(sources):
    made = [G.graph_rows(d, s, ingested_at="now") for s, d in sources.items()] + [G.shared_identifier_rows(sources["persons"])]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.cache()


def test_templates(rows):
    told = {(r.rel_type, r.from_value, r.to_value, r.source_ref) for r in rows.where("kind = 'relation'").collect()}
    assert {("HAS_PHONE", "P1", "+919876543210", "persons:P1"), ("OWNS", "P1", "DL11AB1", "persons:P1"), ("HAS_SOCIAL_ACCOUNT", "P1", "u1", "persons:P1"), ("USES", "P2", "+919876543210", "persons:P2")} <= told
    assert ("CALLED", "P1", "P9", "cdr:P1:P9:2026-01-01") in told and ("HAS_PHONE", "P1", "+919876543210", "cdr:P1:P9:2026-01-01:caller_phone") in told
    assert ("CALLED", "+919876543210", "+919876543211", "cdr:row:2") in told and not any(t[0] == "HAS_PHONE" and t[3].startswith("cdr:row:2") for t in told)
    assert {t for t in told if t[0] in ("FOR_CRIME", "AT_LOCATION", "INVOLVED_IN", "CO_ACCUSED_IN") and t[3].startswith("fir")} == {("FOR_CRIME", "F1", "Theft", "fir:F1:crime"), ("AT_LOCATION", "F1", "Delhi", "fir:F1:location"), ("INVOLVED_IN", "P1", "F1", "fir:F1"), ("CO_ACCUSED_IN", "P1", "F1", "fir:F1"), ("INVOLVED_IN", "P2", "F2", "fir:F2"), ("CO_ACCUSED_IN", "P2", "F2", "fir:F2")}
    assert {t[0] for t in told if t[3].startswith("social")} == {"SOCIAL_REPLY", "INTERACTED_WITH", "ASSOCIATED_WITH"}
    assert len([t for t in told if t[0] == "PRESENT_AT"]) == 3 and ("SHARES_IDENTIFIER", "P1", "P2", "persons:P1:phone:+919876543210") in told
    assert rows.where("from_value = 'No id' or key_value = '1'").count() == 0


def test_provenance(rows):
    shared = rows.where("rel_type = 'SHARES_IDENTIFIER'").head()
    assert (shared.extraction_method, shared.confidence, shared.properties["shared_type"]) == ("inferred", 0.95, "phone")
    called = rows.where("rel_type = 'CALLED' and from_label = 'Phone'").head()
    assert (called.valid_from, called.created_by, called.ingested_at, called.properties["direction"]) == ("2026-01-02", "system", "now", "outbound") and len(called.content_hash) == 64
    assert G.provenance_faults(rows).count() == 0
    broken = rows.withColumn("source_ref", F.when(F.col("rel_type") != "USES", F.col("source_ref")))
    faults = G.provenance_faults(broken).collect()
    assert len(faults) == rows.where("rel_type = 'USES'").count() and all(r.faults == ["source_ref"] for r in faults)


def test_merged_nodes_and_constraints(rows):
    nodes = G.merged_nodes(rows).cache()
    by = {(r.label, r.key_property, r.key_value): r for r in nodes.collect()}
    asha = by["Person", "person_id", "P1"]
    assert asha.properties["name"] == "Asha" and asha.source_refs[0] == "persons:P1"
    assert by["Vehicle", "vehicle_no", "DL11AB1"].properties["vehicle_no"] == "DL11AB1" and ("Person", "person_id", "P9") in by
    report = {(r.label, r.property): r for r in G.uniqueness_report(nodes).collect()}
    assert len(report) == 13 and report["FIR", "fir_id"].nodes == 2 and report["Organisation", "org_id"].nodes == 0 and all(r.values_shared == 0 for r in report.values())
    assert abs(report["Person", "person_id"].values_about - 3) <= 1
    twice = nodes.unionByName(nodes.where("label = 'Crime'").withColumn("key_value", F.lit("other")))
    faults = G.uniqueness_faults(twice).collect()
    assert [(r.label, r.property, r.value, r.nodes) for r in faults] == [("Crime", "name", "Theft", 2)]
    assert {k for k, r in {(r.label, r.property): r.values_shared for r in G.uniqueness_report(twice).collect()}.items() if r} == {("Crime", "name")}


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, S.NODES + ", at long")


def relation(spark, rows):
    return spark.createDataFrame([("CALLED", "Person", "person_id", a, "Person", "person_id", b, r, p, t) for a, b, r, p, t in rows], S.RELATIONS + ", at long")


def test_store_merges_by_key(spark, tmp_path):
    store = S.GraphStore(spark, str(tmp_path / "g"), buckets=8)
    first = nodes_of(spark, [("Person", "person_id", "P1", {"name": "Asha", "city": "Delhi"}, 1), ("Person", "person_id", "P1", {"name": "Asha R", "city": None}, 2), ("Person", "person_id", "P2", None, 3), ("Person", "person_id", None, {"a": "b"}, 4)])
    links = relation(spark, [("P1", "P2", "r1", {"n": "1"}, 1), ("P1", "P2", "r2", {}, 2), ("P1", "P8", "r3", {}, 3)])
    told = store.load(first, links, "at")
    assert told["nodes"] == {"rows": 3, "added": 2, "buckets": told["nodes"]["buckets"]} and told["relations"]["added"] == 2 and told["relations"]["without_ends"] == 1
    read = lambda: {r.key_value: r.properties for r in store.nodes.read().collect()}
    assert read() == {"P1": {"name": "Asha R", "city": "Delhi"}, "P2": {}}
    # the same batch again changes nothing: no folder is written
    before = store.nodes.version()
    again = store.load(first, links, "at")
    assert again["nodes"]["added"] == again["nodes"]["buckets"] == again["relations"]["buckets"] == 0 and store.nodes.version() == before
    # properties are added, the last one wins, a null takes nothing away; an end that comes later lets its relation in
    store.load(nodes_of(spark, [("Person", "person_id", "P1", {"city": "Pune", "name": None, "age": "7"}, 1), ("Person", "person_id", "P8", {}, 2)]), links, "at")
    assert read() == {"P1": {"name": "Asha R", "city": "Pune", "age": "7"}, "P2": {}, "P8": {}}
    assert {r.record_id for r in store.relations.read().collect()} == {"r1", "r2", "r3"}
    assert store.nodes.vacuum() >= 1 and len(read()) == 3 and store.nodes.upsert(nodes_of(spark, []), "at")["rows"] == 0


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = S.KeyedTable(spark, str(tmp_path / "t"), S.NODES, S.NODE_KEY, buckets=4)
    table.upsert(nodes_of(spark, [("A", "k", str(i), {"x": "1"}, i) for i in range(20)]), "at")
    monkeypatch.setattr(S.KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(nodes_of(spark, [("A", "k", "3", {"x": "2"}, 1)]), "at")
    monkeypatch.undo()
    assert {r.properties["x"] for r in table.read().collect()} == {"1"} and table.read().count() == 20
    assert table.upsert(nodes_of(spark, [("A", "k", "3", {"x": "2"}, 1)]), "at")["buckets"] == 1
    assert sorted(r.properties["x"] for r in table.read().collect()) == ["1"] * 19 + ["2"]


def test_an_import_can_be_taken_back(spark, tmp_path):
    root = str(tmp_path / "overlay")
    rows = spark.createDataFrame([("P1", "a/1"), ("P2", "a/1"), ("P3", "b")], "person_id string, _import_id string")
    append_overlay(rows, "persons", root)
    append_overlay(rows.where("person_id = 'P1'").withColumnRenamed("person_id", "fir_id"), "fir", root)
    assert S.remove_import(spark, root, "a/1", ("persons", "fir", "vehicles")) == {"persons": 2, "fir": 1, "vehicles": 0}
    assert [r.person_id for r in spark.read.parquet(f"{root}/persons").collect()] == ["P3"]
    assert S.remove_import(spark, root, "a/1", ("persons",)) == {"persons": 0}


def test_merged_properties_need_no_references(rows):
    names = tuple(dict.fromkeys(p for _, p in G.CONSTRAINTS))
    whole = {tuple(r[:3]): {k: v for k, v in r.properties.items() if k in names} for r in G.merged_nodes(rows).collect()}
    few = G.merged_properties(rows, only=names)
    assert {tuple(r[:3]): r.properties for r in few.collect()} == {k: v for k, v in whole.items() if v} and "source_refs" not in few.columns
    assert sorted(map(tuple, G.uniqueness_report(few).collect())) == sorted(map(tuple, G.uniqueness_report(G.merged_nodes(rows)).collect()))


def test_rows_of_one_kind_are_those_of_all(spark):
    people = spark.createDataFrame([(i, f"P{i}", "98765 43210", "KA01AB1234", None) for i in range(5)], "ord long, person_id string, phone string, vehicle_no string, bank_account string")
    told = lambda df: sorted(tuple(map(str, (r.label, r.key_value, r.rel_type, r.from_value, r.to_value, r.source_ref, r.properties))) for r in df.collect())
    every = G.graph_rows(people, "persons")
    for kind in ("node", "relation"):
        own = told(G.graph_rows(people, "persons", kind=kind))
        assert own and own == told(every.where(F.col("kind") == kind))
    assert G.graph_rows(people, "vehicles", kind="node").columns == every.columns


def test_a_load_writes_its_relations_once_and_without_other_columns(spark, tmp_path, monkeypatch):
    wrote, write = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: wrote.append((name, df.columns)) or write(df, name))
    store = S.GraphStore(spark, str(tmp_path / "g"), buckets=4)
    people = nodes_of(spark, [("Person", "person_id", p, {}, 1) for p in ("P1", "P2")])
    links = relation(spark, [("P1", "P2", "r1", {}, 1), ("P8", "P2", "r2", {}, 2), ("P1", None, "r3", {}, 3), ("P1", "P2", None, {}, 4)]).withColumn("content_hash", F.lit("x"))
    told = store.load(people, links, "at")["relations"]
    assert (told["rows"], told["added"], told["without_ends"]) == (1, 1, 2)
    assert [n for n, _ in wrote] == ["upsert-batch", "upsert-merged", "relations-batch", "upsert-merged"] and "content_hash" not in wrote[2][1]


def test_canonical_relations_are_made_alone_and_not_written(spark, rows, sources, monkeypatch):
    some = [G.graph_rows(d, s, ingested_at="now", types=G.CANONICAL_RELATIONS) for s, d in sources.items()]
    told = lambda df: sorted(tuple(map(str, (r.rel_type, r.from_value, r.to_value, r.source_ref, r.valid_from, r.properties))) for r in df.collect())
    want = rows.where((F.col("kind") == "relation") & F.col("rel_type").isin(*G.CANONICAL_RELATIONS) & (F.col("of_source") != "shared"))
    assert told(reduce(DataFrame.unionByName, some)) == told(want) != []
    wrote = []
    monkeypatch.setattr(plans, "stored", lambda df, name: wrote.append(name) or df)
    db = duckdb.connect()
    for t in ("customer", "nation", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = plans.e6_canonical_relations(spark, SF)
    columns = sorted(mine.columns)
    assert flat(mine.select(*columns).collect()) == flat(db.execute(f"select {', '.join(columns)} from ({plans.ORACLE_SQL['e6_canonical_relations']}) q").fetchall())
    assert wrote == []


def test_a_store_keeps_only_what_counts_and_explodes_only_what_differs(spark, tmp_path, monkeypatch):
    wrote, write = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: wrote.setdefault(name, []).append(df) or write(df, name))
    store = S.GraphStore(spark, str(tmp_path / "g"), buckets=4)
    before = set(spark._jvm.java.io.File(functions.scratch_root(spark)).list() or [])
    people = [("Person", "person_id", f"P{i % 5}", {"city": "Delhi"}, i) for i in range(40)] + [("Person", "person_id", "P1", {"name": "Asha"}, 7), ("Person", "person_id", "P2", {"city": "Pune"}, 3), ("Person", "person_id", "P2", {"city": "Agra"}, 99)]
    links = relation(spark, [("P0", f"P{i}", "r", {"n": "1"}, i) for i in range(9)])
    told = store.load(nodes_of(spark, people), links, "at")
    assert (told["nodes"]["rows"], told["nodes"]["added"], told["relations"]["rows"], told["relations"]["without_ends"]) == (43, 5, 5, 4)
    assert wrote["upsert-batch"][0].count() == 8  # rows that tell the same have become one
    assert {r.key_value: r.properties for r in store.nodes.read().collect()} == {f"P{i}": {"city": "Agra" if i == 2 else "Delhi"} | ({"name": "Asha"} if i == 1 else {}) for i in range(5)}
    # what a load writes on its way is gone, and relations meet the missing ends and not all nodes
    assert set(spark._jvm.java.io.File(functions.scratch_root(spark)).list() or []) == before
    monkeypatch.setattr(S, "FEW", 0)
    again = store.load(nodes_of(spark, people), links, "at")
    assert again["relations"]["without_ends"] == 4 and again["nodes"]["buckets"] == again["relations"]["buckets"] == 0
