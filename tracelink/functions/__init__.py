"""Helpers that the link-analysis operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder of stored() in the shared one that spark.checkpoint.dir names; a temporary one only where that is unset on a single
    machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tracelink-"))
        root = _OWN_FOLDER[0]
    return f"{root.rstrip('/')}/tracelink-graph"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below scratch_root()."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Deletes every table that stored() wrote; call it once results are kept elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: cuts the lineage of iterative jobs and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks to which rows of one key are dealt; a key is frequent with so many rows, and a thousandth of all, at least.
SPREAD, FREQUENT = 64, 10_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], frequent: bool = False, by: str | None = None) -> DataFrame:
    """Left join on keys in which rows with a null key, which match nothing, do not all go to one task: they are dealt by a hash of all
    columns, or of the column `by`, so that columns that nobody asks for need not come along.

    frequent: so are the rows of frequent keys, and right's rows of these come SPREAD times; then left is read twice and should be
    stored. There are at most a thousand such keys, which go to every task.
    """
    own = [by] if by else [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in own]), F.lit(SPREAD)).cast("int")
    absent = F.lit(False)
    for k in keys:
        absent |= F.col(k).isNull()
    if not frequent:
        one = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")  # 0; a plain number would be taken out of the join's keys
        left, right = left.withColumn("line_of_key", F.when(absent, dealt).otherwise(0)), right.withColumn("line_of_key", one)
    else:
        counts = stored(left.where(~absent).groupBy(*keys).agg(F.count("*").alias("rows_of_key")), "key-counts")
        total = counts.agg(F.sum("rows_of_key")).first()[0] or 0
        often = F.broadcast(counts.where(F.col("rows_of_key") > max(FREQUENT, total / 1000)).select(*keys, F.lit(True).alias("often")))
        lines = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        left = left.join(often, keys, "left").withColumn("line_of_key", F.when(absent | F.col("often"), dealt).otherwise(0)).drop("often")
        right = right.join(often, keys, "left").withColumn("line_of_key", F.explode(lines)).drop("often")
    return left.join(right.hint("merge"), [*keys, "line_of_key"], "left").drop("line_of_key")
