"""Join-shaped computations, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.prefix import running_sum
from ..operators.quantiles import quantiles
from ..operators.split import family_split, hashed_sample, newest_held_out
from ..sources.scratch import stored
from .registry import WORDS, query, table

TOOLS = "VALUES ('click','path'),('view','path'),('purchase','query'),('signup','profile')"


@query(f"SELECT event_type, argument, count(*) AS n FROM events LEFT JOIN ({TOOLS}) t(name, argument) ON event_type = name GROUP BY ALL")
def jon_tool_spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01: calls looked up in the table of specifications, which is fixed
    and broadcast; unknown tools stay."""
    specs = spark.sql(f"SELECT * FROM {TOOLS} t(name, argument)")
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return events.join(F.broadcast(specs), F.col("event_type") == F.col("name"), "left").select("event_type", "argument", "n")


@query("SELECT item_id, seed, item_id * 10 + seed AS attempt FROM benchmark, (VALUES (1), (2), (3)) s(seed)")
def jon_task_seed_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: tasks times seeds, as an array of the fixed seeds exploded."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed")).withColumn("attempt", F.col("item_id") * 10 + F.col("seed"))


@query("SELECT source, count(*) AS documents, CAST(max(weight) AS DOUBLE) AS weight FROM documents JOIN (VALUES ('src0', 1.5), ('src1', 2.5), ('src2', 0.5)) r(name, weight) ON source = name GROUP BY source")
def jon_route_by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06: rows routed by name to a verifier's entry."""
    routes = spark.sql("SELECT name, CAST(weight AS DOUBLE) AS weight FROM VALUES ('src0', 1.5D), ('src1', 2.5D), ('src2', 0.5D) r(name, weight)")
    return table(spark, sf_dir, "documents").select("source").join(F.broadcast(routes), F.col("source") == F.col("name")).groupBy("source").agg(F.count("*").alias("documents"), F.max("weight").alias("weight"))


@query(f"SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM (SELECT {WORDS} AS n FROM documents)")
def agg_token_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: sums and exact percentiles by linear interpolation, selected
    without a task that keeps all values."""
    n = stored(table(spark, sf_dir, "documents").select(T.word_count(F.col("text")).alias("n")))
    sums = n.agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))
    p = quantiles(n, F.col("n"), (0.5, 0.9, 0.95, 0.99)).select(*[F.round(f"q{i}", 6).alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))])
    return sums.join(F.broadcast(p))  # one row each


@query(f"SELECT CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS median, CAST(trunc(quantile_cont(n, 0.9)) AS BIGINT) AS p90, max(n) AS longest FROM (SELECT {WORDS} AS n FROM documents)")
def agg_token_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: median, p90 and max, cut to whole numbers, over all rows."""
    n = table(spark, sf_dir, "documents").select(T.word_count(F.col("text")).alias("n"))
    p = quantiles(n, F.col("n"), (0.5, 0.9, 1.0))
    return p.select(F.col("q0").cast("long").alias("median"), F.col("q1").cast("long").alias("p90"), F.col("q2").cast("long").alias("longest"))


@query(f"SELECT role, count(*) AS turns, round(avg({WORDS}), 6) AS mean_tokens, round(quantile_cont({WORDS}, 0.95), 6) AS p95, max(length(text)) AS longest_chars FROM conversations GROUP BY role")
def agg_length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07/08/12/15: lengths by kind of message."""
    rows = stored(table(spark, sf_dir, "conversations").select("role", T.word_count(F.col("text")).alias("n"), F.char_length("text").alias("c")))
    sums = rows.groupBy("role").agg(F.count("*").alias("turns"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("c").cast("long").alias("longest_chars"))
    return sums.join(quantiles(rows, F.col("n"), [0.95], ["role"]).select("role", F.round("q0", 6).alias("p95")), "role").select("role", "turns", "mean_tokens", "p95", "longest_chars")


SPLIT_SQL = """WITH f AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
    s AS (SELECT source, CASE WHEN r <= least(greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM f)"""


@query(f"{SPLIT_SQL} SELECT split, count(*) AS n FROM documents JOIN s USING (source) GROUP BY split")
def agg_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02/03: rows by split."""
    return family_split(table(spark, sf_dir, "documents").select("source"), "source").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS tasks, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS successes, round(avg(value), 6) AS mean_seconds, round(24 * 3 * avg(value) / 3600, 6) AS projected_hours FROM events")
def agg_baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, CMP-08: baseline counts and the projected cost."""
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("tasks"), F.count("*").alias("attempts"), F.count_if(F.col("event_type") != "error").alias("successes"), F.round(F.avg("value"), 6).alias("mean_seconds"), F.round(24 * 3 * F.avg("value") / 3600, 6).alias("projected_hours"))


@query(f"SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS documents, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM (SELECT lang, {WORDS} AS n FROM documents) GROUP BY lang")
def agg_token_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, CMP-32: share of tokens by category."""
    rows = table(spark, sf_dir, "documents").select("lang", T.word_count(F.col("text")).alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))
    return rows.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))), 6))


@query("SELECT count(*) AS episodes, round(avg(CASE WHEN s = 0 THEN 1.0 ELSE 0 END), 6) AS zero_std FROM (SELECT user_id, stddev_pop(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS s FROM events GROUP BY user_id, CAST(ts AS DATE))")
def agg_zero_std_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: share of groups whose rewards do not differ."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.stddev_pop((F.col("event_type") != "error").cast("int")).alias("s"))
    return s.agg(F.count("*").alias("episodes"), F.round(F.avg((F.col("s") == 0).cast("double")), 6).alias("zero_std"))


@query("SELECT event_type, dayofweek(ts) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY GROUPING SETS ((event_type, dayofweek(ts)), (event_type), ())")
def agg_breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: breakdown by several dimensions at once."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.dayofweek("ts") - 1).alias("day"), "value")
    out = rows.groupingSets([["event_type", "day"], ["event_type"], []], "event_type", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return out.select("event_type", F.col("day").cast("long").alias("day"), "n", "mean_value")


@query("SELECT source, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def agg_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: the first example of each server, by an explicit order."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.min_by("lang", "doc_id").alias("lang"))


@query(f"{SPLIT_SQL} SELECT source, split FROM s")
def win_family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-03, WIN-01/02, JON-03: families ranked by hash, a tenth validates."""
    return family_split(table(spark, sf_dir, "documents").select("source").distinct(), "source")


@query("SELECT item_id, CAST(total AS BIGINT) AS total FROM (SELECT item_id, sum(strlen(text)) OVER (ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS total FROM benchmark) WHERE total <= 5000")
def win_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: items in order until a byte budget is used up, by running sums
    over ranges of the order."""
    sizes = table(spark, sf_dir, "benchmark").select("item_id", F.octet_length("text").alias("size"))
    return running_sum(sizes, ["item_id"], "size").where("total <= 5000").select("item_id", "total")


@query("SELECT doc_id, CAST(i AS INTEGER) AS line_number, left(line, 80) AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(Licen|reserved)') ORDER BY doc_id, i LIMIT 200")
def win_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-13, WIN-05: the first 200 matching lines."""
    lines = table(spark, sf_dir, "documents").where(F.col("text").rlike("(Licen|reserved)")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike("(Licen|reserved)")).orderBy("doc_id", "i").limit(200).select("doc_id", (F.col("i") + 1).alias("line_number"), F.left("line", F.lit(80)).alias("line"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25")
def win_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07/09: the same rows at every run, by hash order."""
    return hashed_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 25, "7")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256('s1' || doc_id), 1, 8))::BIGINT < 429496729 THEN 'test' ELSE 'train' END AS split FROM documents")
def win_seeded_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: a seeded split by row, by hash threshold."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("s1"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h < 429496729, "test").otherwise("train").alias("split"))


@query("SELECT o_orderkey, o_orderdate >= (SELECT quantile_disc(o_orderdate, 0.9) FROM orders) AS held_out FROM orders")
def win_temporal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10: the newest tenth is held out, from an exact cutoff, which is
    looked up by day: no task keeps or orders all times."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return newest_held_out(orders, "at").select("o_orderkey", "held_out")


EPISODE = "user_id, CAST(ts AS DATE)"


@query(f"SELECT count(*) AS failures, count(*) FILTER (later) AS recovered FROM (SELECT event_type, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY {EPISODE} ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM events) WHERE event_type = 'error'")
def win_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: failures followed by a success in the episode."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = table(spark, sf_dir, "events").select("event_type", F.coalesce(F.bool_or(F.col("event_type") != "error").over(w), F.lit(False)).alias("later")).where("event_type = 'error'")
    return rows.agg(F.count("*").alias("failures"), F.count_if("later").alias("recovered"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def win_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: the latest by number, not by name."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("state"))


@query("SELECT 'benchmark' AS origin, item_id AS id, length(text) AS size FROM benchmark UNION ALL SELECT 'documents', doc_id, length(text) FROM documents")
def set_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01/02: tables of one schema appended, with their origin."""
    a = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.char_length("text").cast("long").alias("size"))
    return a.unionByName(table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.char_length("text").cast("long").alias("size")))


@query(f"{SPLIT_SQL}, e AS (SELECT DISTINCT source, split FROM s) SELECT count(DISTINCT source) AS families, (SELECT count(*) FROM (SELECT source FROM e GROUP BY source HAVING count(*) > 1)) AS shared, (SELECT count(*) FROM e WHERE split = 'validation') AS held_out FROM e")
def jon_family_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: no family on both sides of the split, and how many are held
    out."""
    rows = family_split(table(spark, sf_dir, "documents").select("source"), "source").distinct().groupBy("source").agg(F.count("*").alias("sides"), F.max("split").alias("split"))
    return rows.agg(F.count("*").alias("families"), F.count_if(F.col("sides") > 1).alias("shared"), F.count_if(F.col("split") == "validation").alias("held_out"))


@query("SELECT DISTINCT source FROM documents EXCEPT SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id % 3 = 0")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: values present in one set and not in another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.select("source").distinct().exceptAll(docs.join(table(spark, sf_dir, "labels"), "doc_id").where("toxic = 1 and doc_id % 3 = 0").select("source").distinct())
