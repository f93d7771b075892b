"""Sources and sinks over folders of files: the append-only overlay, structured uploads and narrative uploads.

A JSON upload is one document a file, so each file is read as one text and parsed by from_json; a folder of many files is one
job. A file that is not what its reader takes gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import scratch
from tracelink.operators import bound

OVERLAY_SOURCES = ("persons", "fir", "vehicles", "entity_mapping")


def append_overlay(rows: DataFrame, source: str, root: str) -> None:
    """Appends imported rows to a source's overlay, one folder for each _import_id, so that a batch can be dropped alone."""
    if source not in OVERLAY_SOURCES:
        raise ValueError(f"no overlay for source {source}")
    rows.repartition("_import_id", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("append").partitionBy("_import_id").parquet(f"{root}/{source}")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("doc"))


def _rows(schema: str, wrappers: tuple[str, ...]):
    """The objects of a document: an array, an array under one of the wrapper keys, or the document alone."""
    wrapped = F.from_json("doc", ", ".join(f"{w} array<struct<{schema}>>" for w in wrappers))
    alone = F.when(F.col("doc").rlike(r"^\s*\{"), F.array(F.from_json("doc", f"struct<{schema}>")))
    listed = F.when(F.col("doc").rlike(r"^\s*\["), F.from_json("doc", f"array<struct<{schema}>>"))
    return F.coalesce(listed, *[wrapped[w] for w in wrappers], alone)


def read_overlay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of overlay files, each a JSON array of objects; other files are skipped. schema: `name: type` pairs."""
    lists = _documents(spark, path).where(F.col("doc").rlike(r"^\s*\["))
    return lists.select(F.explode(F.from_json("doc", f"array<struct<{schema}>>")).alias("r")).where("r is not null").select("r.*")


def read_structured(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, row_no (from 0 in each file) and the columns of schema, from JSON uploads in any of their shapes."""
    rows = _documents(spark, path).select("file", F.posexplode(_rows(schema, ("records", "data", "rows", "items"))).alias("row_no", "r"))
    return rows.where("r is not null").select("file", "row_no", "r.*")


def read_structured_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV uploads with a header row; blank cells are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).csv(path)


def _stem() -> F.Column:
    return F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """text, source_ref, jurisdiction, source of narrative uploads with a text that is not blank.

    A .txt or .md file is one narrative named by its stem; JSON records without a reference are named stem:position.
    """
    docs = _documents(spark, path)
    plain = docs.where(F.lower("file").rlike(r"\.(txt|md)$")).select(F.regexp_replace("doc", "^﻿", "").alias("text"), _stem().alias("source_ref"), F.lit(None).cast("string").alias("jurisdiction"), F.lit("unstructured_fir").alias("source"))
    fields = "text: string, source_ref: string, source: string, jurisdiction: string"
    rows = docs.where(F.lower("file").rlike(r"\.json$")).select("file", F.posexplode(_rows(fields, ("records", "data", "items"))).alias("n", "r"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    ref = F.coalesce(given("r.source_ref"), given("r.source"), F.concat(_stem(), F.lit(":"), (F.col("n") + 1).cast("string")))
    told = rows.select("r.text", ref.alias("source_ref"), "r.jurisdiction", F.coalesce(given("r.source"), F.lit("unstructured_fir")).alias("source"))
    return plain.unionByName(told).where(F.trim("text") != "")


OVERLAY_ROWS = "SELECT 'IMP-' || person_id AS person_id, name, phone, 'batch' || CAST(ord % 3 AS STRING) AS _import_id FROM {persons}"
OVERLAY_BATCH = "SELECT person_id, name, phone FROM ({rows}) o WHERE _import_id = 'batch1'"


def a5_overlay_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of an overlay that was appended in two parts; only its folder is read."""
    rows, root = bound(spark, sf_dir, OVERLAY_ROWS), scratch(spark, "overlay")
    append_overlay(rows.where("_import_id <> 'batch2'"), "persons", root)
    append_overlay(rows.where("_import_id = 'batch2'"), "persons", root)
    return spark.read.parquet(f"{root}/persons").where("_import_id = 'batch1'").select("person_id", "name", "phone")


QUERIES = {"a5_overlay_append": a5_overlay_append}
ORACLE = {"a5_overlay_append": OVERLAY_BATCH.replace("{rows}", OVERLAY_ROWS)}
