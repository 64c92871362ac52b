"""Sinks, file sources and streams: each query writes to a folder of its own
and answers from what it reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import family_split
from ..sources import readers, writers
from ..sources.scratch import scratch
from ..streaming import episodes, ingest
from . import evaluate  # noqa: F401  its SQL is used here
from .registry import ORACLES, query, table
from .relate import SPLIT_SQL


@query("SELECT 'task-' || item_id AS task_id, length(text) AS request_chars, 2 AS visible, 1 AS hidden FROM benchmark")
def src_task_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: a strict manifest in JSON lines, blank lines between."""
    path = scratch(spark)
    task = F.struct(F.concat(F.lit("task-"), F.col("item_id").cast("string")).alias("task_id"), F.lit("r").alias("repo_path"), F.col("text").alias("request"), F.array(F.lit("pytest"), F.lit("-q")).alias("visible_test_command"), F.array(F.lit("hidden")).alias("hidden_test_command"))
    table(spark, sf_dir, "benchmark").select(F.concat(F.to_json(task), F.lit("\n")).alias("value")).write.text(path)
    tasks = readers.tasks(spark, path)
    return tasks.select("task_id", F.char_length("request").cast("long").alias("request_chars"), F.size("visible_test_command").alias("visible"), F.size("hidden_test_command").alias("hidden"))


@query("SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def src_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: all files below a folder, with their relative paths."""
    path = scratch(spark)
    table(spark, sf_dir, "documents").select("text", "lang").write.partitionBy("lang").text(path)
    files = readers.file_tree(spark, path).where(F.col("path").endswith(".txt"))
    return files.groupBy(F.regexp_extract("path", "^lang=([^/]*)/", 1).alias("lang")).agg(F.sum(F.octet_length("content")).alias("bytes"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def snk_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: trajectories as JSON lines in a folder with the time in its
    name."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return spark.read.schema(rows.schema).json(writers.json_lines(rows, scratch(spark)))


@query("SELECT count(*) AS tasks, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_seconds FROM events")
def snk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: a summary as one JSON document."""
    path = scratch(spark)
    row = table(spark, sf_dir, "events").agg(F.count("*").alias("tasks"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_seconds"))
    writers.manifest(row, path)
    return spark.read.schema(row.schema).json(path)


@query(" UNION ALL ".join(f"SELECT * FROM ({SPLIT_SQL.replace('n * 0.1', f'n * {share}')} SELECT '{name}' AS revision, split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN s USING (source) GROUP BY split)" for name, share in (("tenth", 0.1), ("third", 0.3))))
def snk_published_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, GATE-02/06: both splits published as partitions, in two
    revisions of one store; each is read back by its name and verified."""
    base, docs = scratch(spark), table(spark, sf_dir, "documents").select("source", "n_chars")
    writers.refuse_demo("publication", False, "v1")
    names = {tag: writers.publish_revision(family_split(docs, "source", share), base, tag=tag) for tag, share in (("tenth", 0.1), ("third", 0.3))}
    counted = [readers.pinned(spark, base, name).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(tag).alias("revision"), "split", "n", "chars") for tag, name in names.items()]
    return reduce(DataFrame.unionByName, counted)


@query("SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, length(string_agg(text, chr(10) || '<|calibration_document|>' || chr(10) ORDER BY doc_id)) AS written FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 512)")
def snk_corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: the first 512 texts in one file with separator lines; the
    limit is the feature."""
    path = scratch(spark)
    stats = writers.corpus_text(table(spark, sf_dir, "documents"), path, "doc_id")
    text = F.regexp_replace("value", "\\x00\\z", "")
    return spark.read.text(path, wholetext=True).select(F.lit(stats["documents"]).cast("long").alias("documents"), F.lit(stats["chars"]).cast("long").alias("chars"), F.char_length(text).cast("long").alias("written"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 3) AS seconds FROM events GROUP BY event_type")
def str_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: traces that arrive as JSON lines, appended to the store by a
    stream that takes what is there and stops."""
    base = scratch(spark)
    events = table(spark, sf_dir, "events")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").json(f"{base}/in")
        ingest.append(ingest.traces(spark, f"{base}/in"), f"{base}/store", f"{base}/mark").awaitTermination()
    return spark.read.parquet(f"{base}/store").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 3).alias("seconds"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS calls, round(sum(value), 3) AS seconds FROM events GROUP BY 1, 2")
def str_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: calls by hour of event time; the same columns as the stream's."""
    found = ingest.by_window(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "calls", F.round("seconds", 3).alias("seconds"))


@query(f"{SPLIT_SQL} SELECT count(*) AS families, count(*) FILTER (split = 'validation') AS held_out, count(*) >= 2 AS enough FROM s")
def gate_two_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GATE-03: a split needs two families; fewer fail the job."""
    docs = table(spark, sf_dir, "documents").select("source").distinct()
    try:
        family_split(docs.where("source = 'src0'"), "source")
        enough = False
    except ValueError:
        enough = True
    return family_split(docs, "source").agg(F.count("*").alias("families"), F.count_if(F.col("split") == "validation").alias("held_out"), F.lit(enough).alias("enough"))


@query(ORACLES["cmp_episode_accounting"])
def str_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-06, STR-03: episodes accounted as a stream that arrives in three
    batches, is stopped after each and goes on from its checkpoint; the rows
    of the whole log at once.  A last turn of nobody, long after all others,
    moves the watermark past every episode."""
    base, events = scratch(spark), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.max("ts").alias("last"), F.min("ts").alias("first"), (F.min("user_id") - 1).alias("nobody")).first()
    if ends["high"] is None:
        return events.limit(0).select("user_id", F.to_date("ts").alias("day"), F.lit("").alias("termination"), F.lit(0).cast("long").alias("tool_calls"), F.lit(0.0).alias("wall_seconds"), F.lit(0).cast("long").alias("turns"))
    span = (ends["last"] - ends["first"]).days + 1
    kept = spark.conf.get(episodes.SETTING, None)
    spark.conf.set(episodes.SETTING, episodes.PROVIDER)
    try:
        for part in range(3):
            step = (ends["high"] - ends["low"]) // 3 + 1
            rows = events.where((F.col("event_id") - ends["low"] >= part * step) & (F.col("event_id") - ends["low"] < (part + 1) * step))
            if part == 2:
                nobody = rows.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.expr(f"timestamp'{ends['last']}' + interval {span + 9} days").alias("ts"), F.lit(ends["nobody"]).cast(rows.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
                rows = rows.select(nobody.columns).unionByName(nobody)
            rows.write.mode("append").json(f"{base}/in", compression="gzip")
            stream = ingest.traces(spark, f"{base}/in").withColumn("day", F.to_date("ts"))
            calls = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 2).otherwise(1)
            found = episodes.account_stream(stream, ["user_id", "day"], "event_id", "ts", calls, F.col("value"), max_calls=4, timeout=120.0, late=f"{span} days")
            episodes.write_once(found, f"{base}/out", f"{base}/mark").awaitTermination()
    finally:
        spark.conf.unset(episodes.SETTING) if kept is None else spark.conf.set(episodes.SETTING, kept)
    return episodes.read_once(spark, f"{base}/out", f"user_id long, day date, {episodes.RESULT}").where(F.col("user_id") != ends["nobody"]).withColumn("user_id", F.col("user_id").cast(events.schema["user_id"].dataType))
