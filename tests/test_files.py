"""File sources and sinks on hand-made uploads: every shape, bad files, blanks and missing keys."""

import json

import pytest

from tracelink.operators import apply
from tracelink.sources import files

PEOPLE = "person_id: string, name: string, age: int"


def put(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def test_overlay_appends_and_refuses_unknown_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "b1"), ("b", None, "b2")], "person_id string, name string, _import_id string")
    files.append_overlay(rows, "persons", str(tmp_path))
    files.append_overlay(rows.where("_import_id = 'b1'"), "persons", str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/persons")
    assert sorted((r.person_id, r._import_id) for r in got.collect()) == [("a", "b1"), ("a", "b1"), ("b", "b2")]
    with pytest.raises(ValueError):
        files.append_overlay(rows, "cdr", str(tmp_path))


def test_overlay_files_that_are_no_lists_are_skipped(spark, tmp_path):
    put(tmp_path, "a.json", [{"person_id": "1", "name": "A"}, {"person_id": "2", "other": 3}])
    put(tmp_path, "b.json", {"person_id": "3"})
    put(tmp_path, "c.json", "not json")
    put(tmp_path, "d.json", "[]")
    assert sorted(files.read_overlay(spark, str(tmp_path), PEOPLE).collect()) == [("1", "A", None), ("2", None, None)]


def test_structured_uploads_in_every_shape(spark, tmp_path):
    put(tmp_path, "list.json", [{"person_id": "1", "age": 4}])
    for key in ("records", "data", "rows", "items"):
        put(tmp_path, f"{key}.json", {key: [{"person_id": key}, {"person_id": key, "name": "n"}]})
    put(tmp_path, "alone.json", {"person_id": "7"})
    put(tmp_path, "bad.json", "{")
    got = files.read_structured(spark, str(tmp_path), PEOPLE).collect()
    assert sorted(r.person_id for r in got if r.person_id) == ["1", "7", "data", "data", "items", "items", "records", "records", "rows", "rows"]
    assert {(r.person_id, r.row_no) for r in got} >= {("rows", 0), ("rows", 1), ("1", 0)}


def test_csv_uploads(spark, tmp_path):
    put(tmp_path, "a.csv", 'person_id,name,age\n1,"A, B",4\n2,,\n')
    assert sorted(files.read_structured_csv(spark, str(tmp_path), "person_id string, name string, age int").collect()) == [("1", "A, B", 4), ("2", None, None)]


def test_narratives(spark, tmp_path):
    put(tmp_path, "one.txt", "﻿Seen at noon.\nLeft.")
    put(tmp_path, "blank.md", "  ")
    put(tmp_path, "many.json", {"records": [{"text": "a", "source_ref": "R1", "jurisdiction": "DEL"}, {"text": " "}, {"text": "b"}, {"text": "c", "source": "desk"}, {"note": 1}]})
    put(tmp_path, "single.json", {"text": "d"})
    got = {(r.text, r.source_ref, r.jurisdiction, r.source) for r in files.read_narratives(spark, str(tmp_path)).collect()}
    assert got == {("Seen at noon.\nLeft.", "one", None, "unstructured_fir"), ("a", "R1", "DEL", "unstructured_fir"), ("b", "many:3", None, "unstructured_fir"), ("c", "desk", None, "desk"), ("d", "single:1", None, "unstructured_fir")}


def test_a_choice_clears_later_suggestions_only(spark):
    fields = spark.createDataFrame([(1, 1, "Case No", "fir_id"), (1, 2, "Name", "name"), (1, 3, "Mobile", "phone"), (2, 1, "Mobile", "phone"), (2, 2, "Odd", None)], "file_id long, pos int, header string, field string")
    choices = spark.createDataFrame([(1, 1, "phone"), (1, 2, "no_such_field"), (2, 2, "phone")], "file_id long, pos int, choice string")
    aliases = spark.createDataFrame([("mobile", "phone"), ("name", "name")], "compact string, field string")
    got = {(r.file_id, r.pos): (r.field, r.method) for r in apply(spark, "h3_mapping_override", header_fields=fields, header_choices=choices, aliases=aliases).collect()}
    assert got == {(1, 1): ("phone", "user"), (1, 2): (None, "user"), (1, 3): (None, "alias"), (2, 1): ("phone", "alias"), (2, 2): ("phone", "user")}
