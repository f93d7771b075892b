"""Incremental ingestion and recurrence as Structured Streaming jobs over a growing folder of Parquet files.

Each micro-batch overwrites its own folder batch=N, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.functions import scratch
from tracelink.operators import bound
from tracelink.sources import TABLES
from tracelink.streaming.imports import ROCKS

KEY = ["entity_type", "value"]


def run_available(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every new file of path to each(batch, number), then stops."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # the stream source takes a single file only as a pattern; it also matches a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(pattern)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def earlier(spark: SparkSession, target: str, number: int, schema: str) -> DataFrame:
    """What batches before this one have stored at target (none at first)."""
    stored = [f"{target}/batch={n}" for n in range(number)]
    return spark.read.schema(schema).parquet(*stored) if stored else spark.createDataFrame([], schema)


def store_new(spark: SparkSession, path: str, keys: list[str], target: str, log: str, files_each: int = 4) -> None:
    """Stores each different row of keys of the files that are new at path, then stops: hashes seen so far are state of the stream, so
    rows that are stored are neither read again nor overwritten, and the file sink takes each micro-batch once."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_each).parquet(pattern)
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in keys]), {"ignoreNullFields": "false"})
    once = files.select(*keys, F.sha2(text, 256).alias("content_hash")).dropDuplicates(["content_hash"])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        once.writeStream.format("parquet").option("path", target).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def recurrence(sf_dir: str, mentions_at: str, findings_at: str) -> Callable[[DataFrame, int], None]:
    """Appends the mentions of new orders and counts anew only the identifiers that they touch."""
    schema = "source_ref string, jurisdiction string, entity_type string, value string"
    columns = ["source_ref", "jurisdiction", *KEY]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES} | {"orders": batch}
        bound(spark, sf_dir, "SELECT * FROM {mentions}", given).select(*columns).write.mode("overwrite").parquet(f"{mentions_at}/batch={number}")
        new = spark.read.schema(schema).parquet(f"{mentions_at}/batch={number}")
        so_far = new.unionAll(earlier(spark, mentions_at, number, schema).select(*columns))
        touched = so_far.join(new.select(*KEY).distinct(), KEY, "left_semi")
        counts = touched.groupBy(*KEY).agg(F.countDistinct("source_ref").alias("cases"), F.countDistinct("jurisdiction").alias("jurisdictions"))
        counts.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{findings_at}/batch={number}")

    return each


def j1_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different calls (person, other person, kind) of the event stream, each stored once."""
    target, keys = scratch(spark, "ingest"), ["user_id", "props", "event_type"]
    store_new(spark, f"{sf_dir}/events.parquet", keys, target, scratch(spark, "ingest-log"))
    return spark.read.parquet(target).select(*keys)


def j2_incremental_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurring identifiers after all orders have streamed in."""
    findings = scratch(spark, "findings")
    run_available(spark, f"{sf_dir}/orders.parquet", recurrence(sf_dir, scratch(spark, "mentions"), findings), scratch(spark, "findings-log"))
    last = spark.read.parquet(findings).groupBy(*KEY).agg(F.max_by(F.struct("cases", "jurisdictions"), "number").alias("last"))
    return last.select(*KEY, "last.*").where("cases >= 3 AND jurisdictions >= 2")
