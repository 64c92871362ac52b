"""Sinks: partitioned publishing, JSON lines, manifests, joined corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import revisions


def _both_splits(df: DataFrame, demo: bool) -> None:
    if demo:
        raise ValueError("demonstration data is not published")
    found = {r["split"] for r in df.select("split").distinct().collect()}
    if missing := {"train", "validation"} - found:
        raise ValueError(f"splits without rows: {sorted(missing)}")


def publish_splits(df: DataFrame, path: str, demo: bool = False) -> None:
    """Parquet partitioned by split; demonstration data is refused and both
    splits must have rows (SNK-03, GATE-02/06)."""
    _both_splits(df, demo)
    df.write.partitionBy("split").parquet(path)


def publish_revision(df: DataFrame, base: str, demo: bool = False, tag: str | None = None) -> str:
    """The same as a revision that can be pinned by its name (SNK-03)."""
    _both_splits(df, demo)
    return revisions.publish(df, base, ["split"], tag)


def json_lines(df: DataFrame, folder: str, prefix: str = "trajectories") -> str:
    """JSON lines in a folder named by the UTC time (SNK-01)."""
    stamp = df.sparkSession.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")).first()[0]
    path = f"{folder}/{prefix}-{stamp}"
    df.write.json(path)
    return path


def manifest(df: DataFrame, path: str) -> None:
    """One row as one JSON document (SNK-02)."""
    df.select(F.to_json(F.struct("*")).alias("value")).limit(1).coalesce(1).write.text(path)


def corpus_text(df: DataFrame, path: str, key: str, n: int = 512, separator: str = "<|calibration_document|>") -> dict[str, int]:
    """The first n texts by key in one text, a separator line between each two
    and none after the last (SNK-04): documents, characters and words
    written.  n bounds the text, which is one row."""
    first = df.orderBy(key).limit(n).select(F.col(key).alias("k"), F.coalesce("text", F.lit("")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])
    row = first.agg(F.array_join(ordered, f"\n{separator}\n").alias("value"), F.count("*").alias("documents"), F.coalesce(F.sum(F.char_length("v")), F.lit(0)).alias("chars"), F.coalesce(F.sum(T.word_count(F.col("v"))), F.lit(0)).alias("words"))
    row.select("value").coalesce(1).write.option("lineSep", "\0").text(path)
    return {k: v for k, v in row.drop("value").first().asDict().items()}


def refuse_demo(kind: str, demo: bool, revision: str | None) -> None:
    """Training on demonstration rows, or on a revision that is a placeholder,
    is refused (GATE-06); kind says for which run."""
    if demo:
        raise ValueError(f"{kind}: demonstration data is only for a trial of the code")
    if not revision or revision.startswith("REPLACE_"):
        raise ValueError(f"{kind}: the revision must be pinned, not {revision!r}")
