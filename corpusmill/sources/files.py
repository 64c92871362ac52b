"""Single small files and folders on any store that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return bool(store.exists(where))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    store, where = _store(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that a reader finds all of it or what was there
    before: beside its place first, then renamed."""
    store, where = _store(spark, path)
    _, beside = _store(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not store.rename(beside, where):  # some stores do not rename onto a file
        store.delete(where, False)
        if not store.rename(beside, where):
            raise OSError(f"cannot write {path}")


def get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
