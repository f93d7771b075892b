"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_OWN_FOLDER: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset on a single machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tracelink-"))
        root = _OWN_FOLDER[0]
    return root.rstrip("/") + "/tracelink"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every table that materialise() wrote; call it once results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def add_columns(df: DataFrame, inputs: list[str], fn: Callable[..., list], added: str, drop: Iterable[str] = ()) -> DataFrame:
    """df with columns computed batch by batch in Arrow; the other columns pass through untouched.

    fn takes the input columns of one batch and returns one array (or list) for each added column.
    added is a DDL schema. A column of df with an added name is replaced; those in drop are left out.
    """
    new = T.StructType.fromDDL(added)
    gone = {*drop, *new.names}
    keep = [f for f in df.schema.fields if f.name not in gone]
    schema = T.StructType([*keep, *new.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            made = fn(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
            kinds = [arrow.field(f.name).type for f in new.fields]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new.names])

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, most_rows: int = 1000, most_bytes: int = 1 << 22):
    """A batch in slices of at most most_rows rows and about most_bytes of its text column (a longer text comes by itself)."""
    sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = min(begin + most_rows, max(begin + 1, int(np.searchsorted(sizes, done + most_bytes, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end
