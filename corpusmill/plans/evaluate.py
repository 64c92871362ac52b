"""Composite operators: validation, episodes, rewards, deduplication, gates
and the scorecard.  Episodes are a user's events of a day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as T
from ..operators import episodes as E
from ..operators import judgement as J
from ..operators import rewards as R
from ..operators.links import exclusions
from ..operators.quantiles import quantiles
from ..operators.split import within_budget
from ..operators.windows import with_word_count
from ..sources.scratch import stored
from .leaks import LINKS_SQL, VERDICT_SQL
from .registry import NORMAL, WORDS, query, table
from .text_queries import inline, values
from .trajectories import REPLAYED_SQL, replayed

DAY = "user_id, CAST(ts AS DATE) AS day"


@query("SELECT conv_id, count(*) FILTER (role NOT IN ('system', 'user', 'assistant')) AS bad_roles, count(*) FILTER (role = 'assistant' AND prev = 'assistant') AS repeated, arg_min(role, turn) AS opens FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def cmp_validate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-01 on the order of roles alone."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    start = F.struct(F.lit("").alias("prev"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("again"))
    end = F.aggregate("m", start, lambda s, m: F.struct(m["role"].alias("prev"), (s["bad"] + (~m["role"].isin("system", "user", "assistant")).cast("long")).alias("bad"), (s["again"] + ((m["role"] == "assistant") & (s["prev"] == "assistant")).cast("long")).alias("again")))
    return talk.withColumn("e", end).select("conv_id", F.col("e.bad").alias("bad_roles"), F.col("e.again").alias("repeated"), F.col("m")[0]["role"].alias("opens"))


@query(
    f"""WITH a AS (SELECT {DAY}, event_id, CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'click' THEN 2 ELSE 1 END AS calls, value AS seconds FROM events),
    b AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 120 AS late, sum(calls) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS UNBOUNDED PRECEDING) > 4 AS over_budget FROM a),
    c AS (SELECT *, CASE WHEN late THEN 'timeout' WHEN calls = 0 THEN 'assistant_complete' WHEN over_budget THEN 'tool_budget' END AS stop FROM b),
    d AS (SELECT *, coalesce(max(CASE WHEN stop IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM c)
    SELECT user_id, day, coalesce(max(stop), 'tool_budget') AS termination, CAST(coalesce(sum(calls) FILTER (stop IS NULL OR stop = 'assistant_complete'), 0) AS BIGINT) AS tool_calls, round(coalesce(sum(seconds) FILTER (stop IS NULL OR stop <> 'timeout'), 0), 3) AS wall_seconds, count(*) FILTER (stop IS NULL OR stop = 'assistant_complete') AS turns FROM d WHERE stopped = 0 GROUP BY user_id, day"""
)
def cmp_episode_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-06, AGG-05: terminations and usage."""
    turns = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    calls = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 2).otherwise(1)
    return E.account(turns, ["user_id", "day"], "event_id", calls, F.col("value"), max_calls=4, timeout=120.0)


@query("SELECT doc_id, round(0.55 * quality + 0.25 * (1 - toxic) + 0.1 * (doc_id % 2) + 0.05 * (doc_id % 3) / 2 + 0.05 - 0.5 * toxic, 6) AS reward FROM labels")
def cmp_reward_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-10: the named vector as one number."""
    parts = {"hidden_test_fraction": F.col("quality"), "visible_test_fraction": 1 - F.col("toxic"), "build_validity": F.col("doc_id") % 2, "valid_tool_protocol": (F.col("doc_id") % 3) / 2, "bounded_efficiency": F.lit(1), "regression_penalty": F.lit(0), "scope_penalty": F.lit(0), "safety_penalty": 0.5 * F.col("toxic")}
    return table(spark, sf_dir, "labels").select("doc_id", F.round(R.scalar(lambda k: parts[k]), 6).alias("reward"))


@query("SELECT user_id, round(s, 6) AS rate, CASE WHEN s > 0.9 THEN 'trivial' WHEN s BETWEEN 0.2 AND 0.8 THEN 'learnable' WHEN s < 0.2 THEN 'frontier' ELSE 'unassigned' END AS band FROM (SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY user_id)")
def cmp_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-22: difficulty by success rate."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("s"))
    return s.select("user_id", F.round("s", 6).alias("rate"), E.difficulty(F.col("s")).alias("band"))


@query("SELECT band, count(*) AS episodes FROM (SELECT CASE WHEN n < 1 THEN 'none' WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' ELSE '31+' END AS band FROM (SELECT user_id, count(*) FILTER (event_type <> 'view') AS n FROM events GROUP BY user_id, CAST(ts AS DATE))) GROUP BY band")
def cmp_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-23: episodes by number of calls."""
    n = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.count_if(F.col("event_type") != "view").alias("n"))
    return n.groupBy(E.horizon(F.col("n")).alias("band")).agg(F.count("*").alias("episodes"))


@query(f"SELECT band, count(*) AS n, count(*) FILTER (tokens > 8192) AS over_limit FROM (SELECT tokens, CASE WHEN tokens <= 4096 THEN '4096' WHEN tokens <= 8192 THEN '8192' WHEN tokens <= 16384 THEN '16384' ELSE '32K+' END AS band FROM (SELECT {WORDS} AS tokens FROM documents)) GROUP BY band")
def cmp_length_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-24: context bands, and what a limit would drop."""
    n = table(spark, sf_dir, "documents").select(T.word_count(F.col("text")).alias("tokens"))
    return n.groupBy(E.context_band(F.col("tokens")).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("tokens") > 8192).alias("over_limit"))


@query(f"SELECT h, count(*) AS copies, min(doc_id) AS kept FROM (SELECT doc_id, sha256({NORMAL}) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def cmp_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-26, JON-07: normalised copies and the one that stays."""
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h")).groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


GRAMS = f"SELECT {{id}}, unnest(list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', ' '))) AS g FROM (SELECT {{id}}, string_split({NORMAL}, ' ') AS w FROM {{t}}) WHERE len(w) >= 8"


@query(f"SELECT doc_id, item_id, count(DISTINCT d.g) AS shared FROM ({GRAMS.format(id='doc_id', t='documents')}) d JOIN ({GRAMS.format(id='item_id', t='benchmark')}) b ON d.g = b.g GROUP BY doc_id, item_id")
def cmp_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-26, JON-07: documents that share windows of 8 words with items.

    The benchmark's windows are hashed and joined; only 8-byte keys of the
    documents' windows are shuffled, or none if the benchmark's fit the
    broadcast limit.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(T.word_windows(F.col("text"), 8)).alias("g"))

    items = grams(table(spark, sf_dir, "benchmark"), "item_id").distinct()
    return grams(table(spark, sf_dir, "documents"), "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count_distinct("g").alias("shared"))


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, {VERDICT_SQL}
    SELECT 'rows' AS section, lang AS key, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang
    UNION ALL SELECT 'tokens', lang, CAST(sum({WORDS}) AS DOUBLE) FROM documents GROUP BY lang
    UNION ALL SELECT 'length', 'p' || CAST(q * 100 AS INT), round(v, 6) FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS q, unnest(quantile_cont(n, [0.5, 0.9, 0.95, 0.99])) AS v FROM (SELECT {WORDS} AS n FROM documents))
    UNION ALL SELECT 'source', source, CAST(count(*) AS DOUBLE) FROM documents GROUP BY source
    UNION ALL SELECT 'rates', 'pass', round(avg(quality), 6) FROM labels
    UNION ALL SELECT 'rates', 'replay', round(count(*) FILTER (same) / count(*), 6) FROM ({REPLAYED_SQL})
    UNION ALL SELECT 'rates', 'parse', round(count(*) FILTER (parsed) / count(*), 6) FROM ({REPLAYED_SQL})
    UNION ALL SELECT 'rejections', r, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(list_filter([CASE WHEN quality = 0 THEN 'required_tests_fail' END, CASE WHEN toxic = 1 THEN 'verification_cheated' END], lambda x: x IS NOT NULL)) AS r FROM labels) GROUP BY r
    UNION ALL SELECT 'duplicates', w, CAST(count(*) FILTER (verdict = w) AS DOUBLE) FROM verdicts, (VALUES ('equal'), ('near')) t(w) GROUP BY w
    UNION ALL SELECT 'contamination', 'windows', CAST(count(*) FILTER (verdict = 'contaminated') AS DOUBLE) FROM verdicts
    UNION ALL SELECT 'licences', 'stated', CAST(count(DISTINCT source) AS DOUBLE) FROM documents WHERE regexp_matches(text, 'Licen[sc]e')
    UNION ALL SELECT 'template', '{M.SCHEMA_VERSION}', 1.0"""
)
def cmp_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-27, AGG-19: the dataset report in nine sections, one row a figure:
    counts, lengths, distribution, rates, rejections, duplicates and
    contamination, licences, template.

    One scan of the texts leaves a narrow row each, and one pass with grouping
    sets over these makes all counts; duplicates and contamination come from
    the stored verdicts of the exclusion."""
    docs, labels, text = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("text")
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    named = lambda df, section: row(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in df.columns])).alias("x")), section, F.col("x.k"), F.col("x.v"))
    facts = stored(with_word_count(docs.select("doc_id", "lang", "source", text.rlike("Licen[sc]e").alias("licence"), "text"), "text", "n"))
    sums = stored(facts.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping("lang").alias("by_source"), F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.bool_or("licence").alias("licence")))
    langs, sources = sums.where("by_source = 0"), sums.where("by_source = 1")
    shares = (0.5, 0.9, 0.95, 0.99)
    p = quantiles(facts, F.col("n"), shares).select(*[F.round(f"q{i}", 6).alias(f"p{int(q * 100)}") for i, q in enumerate(shares)])
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    verdicts = exclusions(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = stored(verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("equal", "near", "contaminated")]))
    reasons = labels.select(F.explode(J.rejection({"required_tests_fail": F.col("quality") == 0, "verification_cheated": F.col("toxic") == 1})["reasons"]).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    parts = [
        row(langs, "rows", F.col("lang"), F.col("rows")),
        row(langs, "tokens", F.col("lang"), F.col("tokens")),
        named(p, "length"),
        row(sources, "source", F.col("source"), F.col("rows")),
        named(labels.agg(rate(F.col("quality")).alias("pass")), "rates"),
        named(replayed(spark, sf_dir).agg(rate(F.col("same")).alias("replay"), rate(F.col("parsed")).alias("parse")), "rates"),
        row(reasons, "rejections", F.col("r"), F.col("n")),
        named(found.select("equal", "near"), "duplicates"),
        named(found.select(F.col("contaminated").alias("windows")), "contamination"),
        named(sources.agg(F.count_if("licence").alias("stated")), "licences"),
        row(spark.range(1), "template", F.lit(M.SCHEMA_VERSION), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    """WITH e AS (SELECT *, user_id || '/' || CAST(ts AS DATE) AS ep FROM events),
    p AS (SELECT ep, bool_and(event_type <> 'error') AS ok, count(*) AS calls, sum(value) AS seconds FROM e GROUP BY ep),
    c AS (SELECT event_type, coalesce(event_type = lag(event_type) OVER (PARTITION BY ep ORDER BY event_id), false) AS loop, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY ep ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM e)
    SELECT 'episode_success' AS metric, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS value FROM p
    UNION ALL SELECT 'success_low', round(((avg(CASE WHEN ok THEN 1.0 ELSE 0 END) + 1.96*1.96/(2*count(*))) - 1.96*sqrt(avg(CASE WHEN ok THEN 1.0 ELSE 0 END)*(1-avg(CASE WHEN ok THEN 1.0 ELSE 0 END))/count(*) + 1.96*1.96/(4.0*count(*)*count(*)))) / (1 + 1.96*1.96/count(*)), 6) FROM p
    UNION ALL SELECT 'valid_call_rate', round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) FROM c
    UNION ALL SELECT 'recovery_rate', round(avg(CASE WHEN later THEN 1.0 ELSE 0 END), 6) FROM c WHERE event_type = 'error'
    UNION ALL SELECT 'loop_rate', round(avg(CASE WHEN loop THEN 1.0 ELSE 0 END), 6) FROM c
    UNION ALL SELECT 'calls_per_success', round(sum(calls) / nullif(count(*) FILTER (ok), 0), 6) FROM p
    UNION ALL SELECT 'seconds_per_success', round(sum(seconds) / nullif(count(*) FILTER (ok), 0), 6) FROM p"""
)
def met_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-01/04/06/09/11/12 with Wilson's lower bound."""
    day = F.to_date("ts")
    w = Window.partitionBy("user_id", "day").orderBy("event_id")
    ok = F.col("event_type") != "error"
    calls = table(spark, sf_dir, "events").withColumn("day", day).withColumns({"ok": ok, "loop": F.coalesce(F.col("event_type") == F.lag("event_type").over(w), F.lit(False)), "later": F.coalesce(F.bool_or(ok).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))})
    rate = lambda c: F.avg(c.cast("double"))
    per_episode = calls.groupBy("user_id", "day").agg(F.bool_and("ok").alias("good"), F.count("*").alias("n"), F.sum("value").alias("seconds"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & F.col("later")).alias("recovered"), F.count_if("loop").alias("loops"))
    wins = F.count_if("good")
    low, _ = E.wilson(wins, F.count("*"))
    per = lambda c: F.when(wins > 0, F.sum(c) / wins)
    one = per_episode.agg(rate(F.col("good")).alias("episode_success"), low.alias("success_low"), (F.sum("valid") / F.sum("n")).alias("valid_call_rate"), (F.sum("recovered") / F.sum("failed")).alias("recovery_rate"), (F.sum("loops") / F.sum("n")).alias("loop_rate"), per("n").alias("calls_per_success"), per("seconds").alias("seconds_per_success"))
    return one.unpivot([], one.columns, "metric", "value").withColumn("value", F.round("value", 6))


@query("SELECT lang, doc_id, CAST(total AS BIGINT) AS total FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) JOIN (VALUES ('en', 0.5), ('de', 0.3), ('fr', 0.2)) s(l, share) ON lang = l WHERE total <= share * 100000")
def cmp_mixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-25: a mixture by shares of a size budget, in hash order; no task
    orders a whole language."""
    shares = inline(spark, "lang string, share double", [("en", 0.5), ("de", 0.3), ("fr", 0.2)])
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars").join(F.broadcast(shares), "lang")
    return within_budget(docs, "lang", "doc_id", "n_chars").where(F.col("total") <= F.col("share") * 100000).select("lang", "doc_id", "total")


TIERS = [("protocol", 15, 1, 1, 0.25), ("sentinel", 12, 1, 8, 1.6), ("candidate", 24, 3, 12, 14.4), ("release", 40, 3, 15, 30.0)]


@query(f"SELECT tier, round(tasks * attempts * minutes / 60.0, 6) AS upper_hours, round(tasks * attempts * (SELECT avg(value) FROM events) / 3600.0, 6) AS expected_hours, ceiling, round(tasks * attempts * minutes / 60.0, 6) <= ceiling AS within FROM {values(TIERS, 'tier, tasks, attempts, minutes, ceiling')}")
def cmp_budget_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-31, CMP-08: the longest each of the four tiers can take against its
    ceiling, and what it takes at the measured mean."""
    mean = table(spark, sf_dir, "events").agg(F.avg("value").alias("mean"))
    runs = F.col("tasks") * F.col("attempts")
    upper = F.round(runs * F.col("minutes") / 60, 6)
    tiers = inline(spark, "tier string, tasks int, attempts int, minutes int, ceiling double", TIERS).join(F.broadcast(mean))  # four rows and one
    return tiers.select("tier", upper.alias("upper_hours"), F.round(runs * F.col("mean") / 3600, 6).alias("expected_hours"), "ceiling", (upper <= F.col("ceiling")).alias("within"))
