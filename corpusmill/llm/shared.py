"""Helpers that several operators use: tables, durable intermediate results
and Arrow batches cut to bounded pieces."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker turns into numpy arrays at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be any that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.
    Where it is unset, a temporary one is set if all runs in one machine's
    process; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        atexit.register(shutil.rmtree, urlparse(folder).path, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation and the work is done once.  The
    files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            _drop(df.sparkSession, folder)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: whatever they are called, they clash
    with no name that an operator adds.  `named` gives their names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The first columns under their old names, and further ones."""
    return df.select(*[f"c{i}" for i in range(len(names))], *more).toDF(*names, *more)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named text column has at most `most` bytes
    in each piece, or one row: memory is bounded by the longest document."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
