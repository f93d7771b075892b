"""Imports as a stream: rows of new files are checked and stored once, with the hashes seen so far as state of the stream.

Nothing that was stored earlier is read again: whether a row's content has been seen is answered by the state store, which is
written with the checkpoint, so a stream that ends or dies goes on where it was. The file sink commits each micro-batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import spread_join
from tracelink.operators.imports import TARGETS, checked, identity_hash, split_row

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "row_of_upload"


def import_rows(files: DataFrame, existing: DataFrame, fields: dict[str, str] | None = None, admin: bool = False, jurisdictions: tuple[str, ...] = (), seen_at: str | None = None, late: str | None = None) -> DataFrame:
    """Each different row of a stream (or table) of uploads once: its fields, unmapped values, content_hash, identity, status, reasons
    and disposition.

    existing(fir_id) are keys that are stored already; their rows are duplicates, never overwritten. All columns are part of the
    content, so it does not matter which of two equal rows comes through. The hashes stay in the state for ever, or, with a time
    column seen_at and a delay late ("2 days"), as long as the watermark allows. fields: column -> field; None: columns are fields.
    """
    own = [c for c in files.columns if c != seen_at]
    timed = files.withWatermark(seen_at, late) if late else files
    text = F.to_json(F.struct(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in sorted(own)]))
    hashed = timed.withColumn(ROW, F.sha2(text, 256))
    once = hashed.dropDuplicatesWithinWatermark([ROW]) if late else hashed.dropDuplicates([ROW])
    told = checked(split_row(once.select(ROW, *own), fields or {c: c for c in own if c in TARGETS}, ROW), admin, jurisdictions)
    keys = existing.where("fir_id is not null").select("fir_id", F.lit(True).alias("stored_before")).distinct()
    joined = spread_join(told, keys, ["fir_id"])
    known = F.coalesce("stored_before", F.lit(False)) & (F.col("status") != "unauthorized")
    status = F.when(known, "duplicate").otherwise(F.col("status"))
    disposition = F.when(status == "ready", "import").otherwise("unresolved")
    kept = [*TARGETS, "unmapped", "reasons"]
    return joined.select(F.col(ROW).alias("content_hash"), *kept, status.alias("status"), identity_hash().alias("identity"), disposition.alias("disposition"))


def run_imports(spark: SparkSession, folder: str, schema: str, existing: DataFrame, target: str, log: str, files_each: int = 1, kind: str = "parquet", **options) -> None:
    """Stores what the new files of a folder hold below target, by disposition, and stops. options: those of import_rows()."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(kind).load(folder)
        rows = import_rows(files, existing, **options)
        rows.writeStream.format("parquet").partitionBy("disposition").option("path", target).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
