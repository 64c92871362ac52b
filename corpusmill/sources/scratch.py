"""A folder for what a query writes and reads back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        files.remove(spark, folder)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def scratch(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and
    executors share; where that is unset and all runs in one process, below a
    temporary folder.  The folder goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
    folder = f"{base}/queries/{uuid.uuid4().hex}"
    atexit.register(_drop, spark, folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written to a scratch folder and read back: the lineage ends there,
    so it is computed once, a lost executor costs no recomputation, and
    adaptive execution sees its sizes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            _drop(df.sparkSession, folder)
