"""Evaluation queries over episode-shaped rows.

An event is a call: its user is the task, event_id % 3 the seed, the side
(event_id // 3) % 2 says whether parent (0) or candidate (1) made it, props.k
is its size in lines, value its seconds.  An episode is a task, seed and side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import episodes as E
from ..operators import judgement as J
from ..operators.quantiles import quantiles
from ..sources.scratch import stored
from .patching import PATCHES_SQL, reviewed
from .registry import WORDS, query, table
from .text_queries import inline, values
from .trajectories import TALK, trajectories

CALLS = """c AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS task, event_id % 3 AS seed, (event_id // 3) % 2 AS side FROM events),
    d AS (SELECT *, coalesce(event_type = lag(event_type) OVER w AND k // 10 = lag(k // 10) OVER w AND value >= lag(value) OVER w, false) AS looped, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY task, seed, side ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM c WINDOW w AS (PARTITION BY task, seed, side ORDER BY event_id))"""
EPISODES = f"""{CALLS}, e AS (SELECT task, seed, side, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS valid, count(*) FILTER (event_type NOT IN ('error', 'view')) AS executed, count(*) AS visible_total, count(*) FILTER (value < 60) AS visible_passed, 2 * count(*) FILTER (value < 60) > count(*) AS hidden,
    bool_or(event_type = 'purchase') AS claimed, bool_or(event_type = 'signup') AS verified, sum(CASE WHEN k < 70 THEN k ELSE 0 END) AS relevant_lines, sum(k) AS total_lines, sum(length(props)) AS tokens, sum(value) AS seconds, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error' AND later) AS recovered, count(*) FILTER (looped) AS loops FROM d GROUP BY task, seed, side)"""
KEYS = ["task", "seed", "side"]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = Window.partitionBy(*KEYS).orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props", F.from_json("props", "k bigint")["k"].alias("k"), F.col("user_id").alias("task"), (F.col("event_id") % 3).alias("seed"), (F.floor(F.col("event_id") / 3) % 2).alias("side"))
    before = lambda c: F.lag(c).over(ordered)
    # an equivalent action: the same tool on the same ten of lines, and nothing got faster
    looped = (F.col("event_type") == before("event_type")) & (F.floor(F.col("k") / 10) == before(F.floor(F.col("k") / 10))) & (F.col("value") >= before("value"))
    later = F.bool_or(F.col("event_type") != "error").over(ordered.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"looped": F.coalesce(looped, F.lit(False)), "later": F.coalesce(later, F.lit(False))})


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error, fast = F.col("event_type") == "error", F.count_if(F.col("value") < 60)
    return calls(spark, sf_dir).groupBy(*KEYS).agg(
        F.count("*").alias("calls"), F.count_if(~error).alias("valid"), F.count_if(~F.col("event_type").isin("error", "view")).alias("executed"),
        F.count("*").alias("visible_total"), fast.alias("visible_passed"), (2 * fast > F.count("*")).alias("hidden"),
        F.bool_or(F.col("event_type") == "purchase").alias("claimed"), F.bool_or(F.col("event_type") == "signup").alias("verified"),
        F.sum(F.when(F.col("k") < 70, F.col("k")).otherwise(0)).alias("relevant_lines"), F.sum("k").alias("total_lines"), F.sum(F.char_length("props")).alias("tokens"), F.sum("value").alias("seconds"),
        F.count_if(error).alias("failures"), F.count_if(error & F.col("later")).alias("recovered"), F.count_if("looped").alias("loops"),
    )


RATES = """count(*) AS episodes, round(count(*) FILTER (hidden) / count(*), 6) AS success, round(sum(visible_passed) / sum(visible_total), 6) AS visible_fraction, round(sum(valid) / sum(calls), 6) AS valid_calls, round(sum(executed) / nullif(sum(valid), 0), 6) AS argument_success, round(sum(recovered) / nullif(sum(failures), 0), 6) AS recovery,
    round(count(*) FILTER (claimed AND NOT verified) / count(*), 6) AS unsupported_claims, round(sum(relevant_lines) / nullif(sum(total_lines), 0), 6) AS patch_precision, round(sum(calls) / nullif(count(*) FILTER (hidden), 0), 6) AS calls_per_success, round(sum(tokens) / nullif(count(*) FILTER (hidden), 0), 6) AS tokens_per_success, round(sum(seconds) / nullif(count(*) FILTER (hidden), 0), 6) AS seconds_per_success, round(sum(loops) / sum(calls), 6) AS loop_rate"""


@query(f"WITH {EPISODES} SELECT side, {RATES} FROM e GROUP BY side")
def met_episode_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, MET-01/02 and MET-04 to MET-12: the scorecard of candidate and
    parent over whole episodes."""
    return J.episode_rates(episodes(spark, sf_dir), "side")


@query(f"WITH {CALLS}, t AS (SELECT task, event_type AS test, bool_or(value < 60) FILTER (side = 0) AS a, bool_or(value < 60) FILTER (side = 1) AS b FROM d GROUP BY 1, 2) SELECT count(*) AS tests, count(*) FILTER (a AND NOT b) AS regressed, round(count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (a), 0), 6) AS regression_rate FROM t WHERE a IS NOT NULL AND b IS NOT NULL")
def met_test_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-03: tests, by their id, that pass on the parent and fail on the
    candidate, of those that pass on the parent."""
    ok = F.col("value") < 60
    side = lambda n, name: calls(spark, sf_dir).where(F.col("side") == n).groupBy("task", F.col("event_type").alias("test")).agg(F.bool_or(ok).alias(name))
    both = side(0, "a").join(side(1, "b"), ["task", "test"])
    lost = F.count_if(F.col("a") & ~F.col("b"))
    return both.agg(F.count("*").alias("tests"), lost.alias("regressed"), F.round(lost / F.nullif(F.count_if("a"), F.lit(0)), 6).alias("regression_rate"))


@query(f"WITH {EPISODES} SELECT p.task, p.seed, p.hidden AS parent, c.hidden AS candidate, CAST(c.hidden AS INT) - CAST(p.hidden AS INT) AS delta, c.calls - p.calls AS more_calls FROM e p JOIN e c ON p.task = c.task AND p.seed = c.seed AND p.side = 0 AND c.side = 1")
def jon_task_seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: outcomes of candidate and parent on the same task and seed."""
    e = episodes(spark, sf_dir)
    p = e.where("side = 0").select("task", "seed", F.col("hidden").alias("parent"), F.col("calls").alias("p"))
    c = e.where("side = 1").select("task", "seed", F.col("hidden").alias("candidate"), F.col("calls").alias("c"))
    return p.join(c, ["task", "seed"]).select("task", "seed", "parent", "candidate", (F.col("candidate").cast("int") - F.col("parent").cast("int")).alias("delta"), (F.col("c") - F.col("p")).alias("more_calls"))


@query(f"WITH {CALLS} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' AND value < 5 THEN 'infrastructure' WHEN event_type = 'error' AND k % 10 < 3 THEN 'invalid_json' WHEN event_type = 'error' AND k % 10 < 5 THEN 'unknown_tool' WHEN event_type = 'error' THEN 'tool_failure' WHEN looped THEN 'loop' WHEN k > 95 THEN 'truncated' WHEN value > 200 THEN 'budget' WHEN k % 13 = 3 THEN 'patch_failed' WHEN k % 13 = 4 THEN 'build_failed' WHEN k % 13 = 5 THEN 'visible_regression' WHEN k % 13 = 6 THEN 'hidden_failure' ELSE 'correct' END AS outcome FROM d) GROUP BY outcome")
def cmp_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-29: the twelve outcomes, each row one, infrastructure first."""
    error, k = F.col("event_type") == "error", F.col("k")
    flags = {
        "infrastructure": error & (F.col("value") < 5), "invalid_json": error & (k % 10 < 3), "unknown_tool": error & (k % 10 < 5), "tool_failure": error, "loop": F.col("looped"), "truncated": k > 95, "budget": F.col("value") > 200,
        "patch_failed": k % 13 == 3, "build_failed": k % 13 == 4, "visible_regression": k % 13 == 5, "hidden_failure": k % 13 == 6,
    }
    return calls(spark, sf_dir).groupBy(E.outcome(flags).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {EPISODES}, n AS (SELECT *, row_number() OVER (PARTITION BY task, seed, side ORDER BY event_id) AS i FROM d),
    x AS (SELECT task, seed, p.i AS i, c.event_type AS theirs, c.k AS k, c.looped AS looped, p.event_type AS ours FROM (SELECT * FROM n WHERE side = 0) p LEFT JOIN (SELECT * FROM n WHERE side = 1) c USING (task, seed, i) WHERE c.event_type IS DISTINCT FROM p.event_type),
    f AS (SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY i) AS r FROM x),
    g AS (SELECT task, seed, bool_and(hidden) AS both_succeed FROM e GROUP BY task, seed HAVING count(*) = 2)
    SELECT task, seed, CAST(i AS BIGINT) AS first_divergence, CASE WHEN both_succeed THEN 'different_plan' WHEN k > 95 THEN 'template_incompatible' WHEN theirs IS NULL THEN 'premature_completion' WHEN looped THEN 'loop' WHEN theirs = 'error' AND k % 10 < 3 THEN 'invalid_tool' WHEN theirs = 'error' AND k % 10 < 6 THEN 'corrupted_arguments' WHEN theirs = 'error' THEN 'incorrect_token' ELSE 'lost_fact' END AS category
    FROM f JOIN g USING (task, seed) WHERE r = 1"""
)
def cmp_divergence_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-30: where a candidate first leaves its parent's actions, and which
    of the eight categories that is.  Actions are numbered and joined, so no
    episode becomes one row."""
    n = calls(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("event_id")))
    p = n.where("side = 0").select("task", "seed", "i", F.col("event_type").alias("ours"))
    c = n.where("side = 1").select("task", "seed", "i", F.col("event_type").alias("theirs"), "k", "looped")
    unequal = p.join(c, ["task", "seed", "i"], "left").where(~F.col("ours").eqNullSafe(F.col("theirs")))
    first = unequal.groupBy("task", "seed").agg(F.min_by(F.struct("i", "theirs", "k", "looped"), "i").alias("x")).select("task", "seed", "x.*")
    both = episodes(spark, sf_dir).groupBy("task", "seed").agg(F.bool_and("hidden").alias("both_succeed"), F.count("*").alias("sides")).where("sides = 2")
    error, k = F.col("theirs") == "error", F.col("k")
    flags = {"template_incompatible": k > 95, "premature_completion": F.col("theirs").isNull(), "loop": F.col("looped"), "invalid_tool": error & (k % 10 < 3), "corrupted_arguments": error & (k % 10 < 6), "incorrect_token": error}
    return first.join(both, ["task", "seed"]).select("task", "seed", F.col("i").cast("long").alias("first_divergence"), J.divergence(flags, F.col("both_succeed")).alias("category"))


REJECTED = f"""{PATCHES_SQL}, r AS (SELECT doc_id, source, list_filter([CASE WHEN NOT applies THEN 'patch_does_not_apply' END, CASE WHEN quality = 0 THEN 'required_tests_fail' END, CASE WHEN NOT in_scope THEN 'edits_out_of_scope' END, CASE WHEN contains(text, '<tool_call>') THEN 'calls_do_not_round_trip' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]+') THEN 'leaked_data' END, CASE WHEN toxic = 1 THEN 'verification_cheated' END, CASE WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 'truncated' END, CASE WHEN {WORDS} > 512 THEN 'too_long' END], lambda x: x IS NOT NULL) AS reasons FROM documents JOIN labels USING (doc_id) JOIN (SELECT doc_id, applies, in_scope FROM patches) USING (doc_id)),
    l AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'sft' WHEN len(list_filter(reasons, lambda x: x NOT IN ('patch_does_not_apply', 'required_tests_fail'))) = 0 THEN 'preference' ELSE 'reject' END AS lane FROM r)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").join(reviewed(spark, sf_dir).select("doc_id", "applies", "in_scope"), "doc_id")
    flags = {
        "patch_does_not_apply": ~F.col("applies"), "required_tests_fail": F.col("quality") == 0, "edits_out_of_scope": ~F.col("in_scope"), "calls_do_not_round_trip": F.col("text").contains("<tool_call>"),
        "leaked_data": F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"), "verification_cheated": F.col("toxic") == 1, "truncated": ~F.col("text").rlike(r"[.!?]\s*\z"), "too_long": T.word_count(F.col("text")) > 512,
    }
    return docs.select("doc_id", "source", J.rejection(flags).alias("j")).select("doc_id", "source", "j.reasons", "j.lane")


@query(f"WITH {REJECTED} SELECT doc_id, coalesce(array_to_string(reasons, ','), '') AS reasons, lane FROM l")
def cmp_demonstration_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-20: all eight reasons of every demonstration, and its lane: failed
    finals are candidates for preference pairs."""
    return judged(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "lane")


@query(f"WITH {REJECTED} SELECT reason, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, unnest(reasons) AS reason FROM l) GROUP BY reason")
def agg_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: rejection reasons with how often and in how many sources."""
    return judged(spark, sf_dir).select("source", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("SELECT source, lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '(Licen[sc]e|CC BY|rights reserved)')) AS with_notice, CASE WHEN count(*) FILTER (regexp_matches(text, '(Licen[sc]e|CC BY|rights reserved)')) > 0 THEN 'stated' ELSE 'unknown' END AS licence FROM documents GROUP BY source, lang")
def agg_source_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: the table of sources, languages and licence notices."""
    n = F.count_if(F.col("text").rlike("(Licen[sc]e|CC BY|rights reserved)"))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), n.alias("with_notice"), F.when(n > 0, "stated").otherwise("unknown").alias("licence"))


FACTS = "SELECT source, concat_ws(',', CASE WHEN max(n_chars) < 20000 THEN 'revision' END, CASE WHEN count(*) FILTER (regexp_matches(text, 'Licen[sc]e')) = 0 THEN 'licence' END, CASE WHEN count(*) FILTER (lang = 'en') = 0 THEN 'provenance' END, CASE WHEN count(DISTINCT lang) < 4 THEN 'overlap_risk' END, CASE WHEN max(doc_id) % 2 = 0 THEN 'tests_executed' END, CASE WHEN min(doc_id) % 3 = 0 THEN 'schema_and_format' END, CASE WHEN count(*) FILTER (contains(text, '@')) = 0 THEN 'transformations' END) AS missing FROM documents GROUP BY source"


@query(FACTS)
def cmp_source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-33: which of the seven facts each source lacks."""
    has = lambda c: F.max(F.when(c, "yes"))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("size"), has(F.col("text").rlike("Licen[sc]e")).alias("licence"), has(F.col("lang") == "en").alias("provenance"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("last"), F.min("doc_id").alias("first"), has(F.col("text").contains("@")).alias("transformations"))
    given = lambda c: F.when(c, "yes")
    facts = {"revision": given(F.col("size") >= 20000), "licence": F.col("licence"), "provenance": F.col("provenance"), "overlap_risk": given(F.col("langs") >= 4), "tests_executed": given(F.col("last") % 2 != 0), "schema_and_format": F.when(F.col("first") % 3 != 0, "chatml").otherwise(" "), "transformations": F.col("transformations")}
    return rows.select("source", F.array_join(J.missing(facts, J.SOURCE_FACTS), ",").alias("missing"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'parent_and_lineage' END, CASE WHEN p_partkey % 3 = 0 THEN 'commits' END, CASE WHEN p_partkey % 5 = 0 THEN 'type_and_bits' END, CASE WHEN p_partkey % 7 = 0 THEN 'calibration' END, 'template_hash', CASE WHEN p_partkey % 11 = 0 THEN 'evaluation' END, CASE WHEN p_partkey % 13 = 0 THEN 'runtime_settings' END, CASE WHEN p_partkey % 17 = 0 THEN 'limitations' END) AS missing FROM part")
def cmp_release_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-34: which of the eight facts each release manifest lacks; one that
    no column gives is missing everywhere."""
    given = lambda n: F.when(F.col("p_partkey") % n != 0, "yes")
    facts = dict(zip([f for f in J.RELEASE_FACTS if f != "template_hash"], map(given, (2, 3, 5, 7, 11, 13, 17)), strict=True))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(J.missing(facts, J.RELEASE_FACTS), ",").alias("missing"))


P = "round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, CAST(max(n) AS DOUBLE) AS longest, round(avg(n), 6) AS mean"


def _long(rows: DataFrame, measures: dict[str, F.Column]) -> DataFrame:
    """Mean, percentiles and maximum of each measure, one row each."""
    flat = stored(rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("n")) for k, v in measures.items()])).alias("x")).select("x.*"))
    sums = flat.groupBy("measure").agg(F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))
    p = quantiles(flat, F.col("n"), (0.5, 0.9, 0.95, 0.99), ["measure"]).select("measure", *[F.round(f"q{i}", 6).alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))])
    return p.join(sums, "measure")


@query(f"{TALK}, {PATCHES_SQL}, m AS (SELECT conv_id, role, path, {WORDS} AS n FROM (SELECT *, content AS text FROM t)), v AS (SELECT sum(n) AS a, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS b, coalesce(sum(n) FILTER (role = 'tool'), 0) AS c, count(path) AS d FROM m GROUP BY conv_id), u AS (SELECT unnest([{{'m': 'sequence', 'n': a}}, {{'m': 'target', 'n': b}}, {{'m': 'tool_output', 'n': c}}, {{'m': 'calls', 'n': d}}]) AS x FROM v), w AS (SELECT x.m AS measure, x.n AS n FROM u UNION ALL SELECT 'patch', total FROM patches) SELECT measure, {P} FROM w GROUP BY measure")
def agg_five_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: the five published measures of length, p50 to p99 and maximum:
    words of a trajectory, of its trained turns and of its tools' answers, its
    calls, and changed lines of a patch."""
    words = lambda role: F.aggregate(F.transform(F.filter("messages", lambda m: (m["role"] == role) if role else F.lit(True)), lambda m: T.word_count(m["content"])), F.lit(0).cast("long"), lambda a, n: a + n)
    made = F.size(F.filter("messages", lambda m: F.size(m["tool_calls"]) > 0))
    rows = trajectories(spark, sf_dir).select(words(None).alias("sequence"), words("assistant").alias("target"), words("tool").alias("tool_output"), made.cast("long").alias("calls"), F.lit(None).cast("long").alias("patch"))
    sizes = reviewed(spark, sf_dir).select(*[F.lit(None).cast("long").alias(c) for c in rows.columns[:4]], F.col("total").alias("patch"))
    return _long(rows.unionByName(sizes), {c: F.col(c) for c in rows.columns})


@query(f"WITH {EPISODES}, u AS (SELECT unnest([{{'m': 'seconds', 'n': seconds}}, {{'m': 'tokens', 'n': CAST(tokens AS DOUBLE)}}, {{'m': 'calls', 'n': CAST(calls AS DOUBLE)}}]) AS x FROM e), w AS (SELECT x.m AS measure, x.n AS n FROM u) SELECT measure, {P} FROM w GROUP BY measure")
def agg_episode_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: mean, p50 and p95 of duration, tokens and calls."""
    return _long(episodes(spark, sf_dir), {k: F.col(k) for k in ("seconds", "tokens", "calls")})


CATEGORIES = [("agent", 0.45), ("generation", 0.20), ("debugging", 0.20), ("protocol", 0.10), ("general", 0.05)]


@query(f"SELECT name AS category, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / sum(sum(n)) OVER (), 6) AS share, max(target) AS target, round(sum(n) / sum(sum(n)) OVER () - max(target), 6) AS gap FROM (SELECT CAST(substr(source, 4) AS INT) % 5 AS c, {WORDS} AS n FROM documents) JOIN {values([(i, *c) for i, c in enumerate(CATEGORIES)], 'i, name, target')} ON c = i GROUP BY name")
def agg_mixture_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, CMP-32: rows, tokens and share of each category against the
    mixture that is aimed at."""
    names = inline(spark, "c int, category string, target double", [(i, *c) for i, c in enumerate(CATEGORIES)])
    docs = table(spark, sf_dir, "documents").select((F.substring("source", 4, 9).cast("int") % 5).alias("c"), T.word_count(F.col("text")).alias("n"))
    sums = docs.groupBy("c").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).join(F.broadcast(names), "c")
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return sums.withColumn("s", share).select("category", "rows", "tokens", F.round("s", 6).alias("share"), "target", F.round(F.col("s") - F.col("target"), 6).alias("gap"))


LINES = "len(string_split(text, chr(10)))"


@query(f"SELECT kind, lang, horizon, band, count(*) AS n, round(avg(quality), 6) AS success FROM (SELECT source AS kind, lang, quality, CASE WHEN {LINES} < 1 THEN 'none' WHEN {LINES} <= 5 THEN '1-5' WHEN {LINES} <= 15 THEN '6-15' WHEN {LINES} <= 30 THEN '16-30' ELSE '31+' END AS horizon, CASE WHEN {WORDS} <= 4096 THEN '4096' WHEN {WORDS} <= 8192 THEN '8192' WHEN {WORDS} <= 16384 THEN '16384' ELSE '32K+' END AS band FROM documents JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((kind), (lang), (horizon), (band), (lang, horizon), ())")
def agg_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: results by type, language, horizon and context band at once."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(F.col("source").alias("kind"), "lang", "quality", E.horizon(F.size(F.split("text", "\n"))).alias("horizon"), E.context_band(T.word_count(F.col("text"))).alias("band"))
    return rows.groupingSets([["kind"], ["lang"], ["horizon"], ["band"], ["lang", "horizon"], []], "kind", "lang", "horizon", "band").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("success"))


@query(f"WITH {EPISODES}, s AS (SELECT *, CASE WHEN calls < 1 THEN 'none' WHEN calls <= 5 THEN '1-5' WHEN calls <= 15 THEN '6-15' WHEN calls <= 30 THEN '16-30' ELSE '31+' END AS horizon, CASE seed WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'xhigh' END AS effort, CASE WHEN failures = 0 THEN 'first attempt' WHEN recovered > 0 THEN 'recovered' ELSE 'failed' END AS recovery FROM e), u AS (SELECT unnest([{{'d': 'horizon', 'v': horizon}}, {{'d': 'effort', 'v': effort}}, {{'d': 'recovery', 'v': recovery}}]) AS x FROM s), q AS (SELECT x.d AS dimension, x.v AS value, count(*) AS n FROM u GROUP BY x.d, x.v UNION ALL SELECT 'language', lang, count(*) FROM documents GROUP BY lang) SELECT *, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM q")
def cmp_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-32: shares by horizon, effort, recovery and language."""
    e = episodes(spark, sf_dir)
    effort = F.when(F.col("seed") == 0, "low").when(F.col("seed") == 1, "medium").otherwise("xhigh")
    recovery = F.when(F.col("failures") == 0, "first attempt").when(F.col("recovered") > 0, "recovered").otherwise("failed")
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in (("horizon", E.horizon(F.col("calls"))), ("effort", effort), ("recovery", recovery))])
    n = e.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    n = n.unionByName(table(spark, sf_dir, "documents").groupBy(F.lit("language").alias("dimension"), F.col("lang").alias("value")).agg(F.count("*").alias("n")))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dimension")), 6))


@query(
    f"""WITH {EPISODES}, m AS (SELECT side, avg(CAST(hidden AS INT)) AS success, sum(visible_passed) / sum(visible_total) AS static, count(*) FILTER (claimed AND NOT verified) / count(*) AS claims, sum(loops) / sum(calls) AS loops, sum(valid) / sum(calls) AS valid, sum(tokens) / count(*) AS tokens, avg(CAST(hidden AS INT)) FILTER (calls BETWEEN 6 AND 15) AS medium, avg(CAST(hidden AS INT)) FILTER (calls > 15) AS long FROM e GROUP BY side)
    SELECT c.valid >= p.valid AS sft_protocol, c.success >= p.success AS sft_success, c.static >= 0.98 * p.static AS sft_static, c.claims <= p.claims AS sft_claims, coalesce(c.medium > p.medium, false) AS sft_medium, coalesce(c.long > p.long, false) AS sft_long, c.success - p.success >= 0.03 AS rl_success, c.tokens <= 1.1 * p.tokens AS rl_length, c.loops <= 1.1 * p.loops AS rl_loops, p.success - c.success <= 0.01 AND c.valid >= p.valid AS four_bit, p.success - c.success <= 0.02 AS three_bit, p.success - c.success <= 0.05 AS two_bit, false AS one_bit
    FROM m p JOIN m c ON p.side = 0 AND c.side = 1"""
)
def cmp_stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-28: the gates of the three stages, candidate against parent; one
    bit has no gate to pass."""
    part = lambda c: F.avg(F.when(c, F.col("hidden").cast("int")))
    m = episodes(spark, sf_dir).groupBy("side").agg(
        F.avg(F.col("hidden").cast("int")).alias("success"), (F.sum("visible_passed") / F.sum("visible_total")).alias("static"), (F.count_if(F.col("claimed") & ~F.col("verified")) / F.count("*")).alias("claims"), (F.sum("loops") / F.sum("calls")).alias("loops"),
        (F.sum("valid") / F.sum("calls")).alias("valid"), (F.sum("tokens") / F.count("*")).alias("tokens"), part(F.col("calls").between(6, 15)).alias("medium"), part(F.col("calls") > 15).alias("long"),
    )
    side = lambda n: m.where(F.col("side") == n).select(F.struct([c for c in m.columns if c != "side"]).alias("pc"[n]))
    both = side(0).join(F.broadcast(side(1)))  # one row each
    p, c = F.col("p"), F.col("c")
    lost = p["success"] - c["success"]
    gates = {
        "sft_protocol": c["valid"] >= p["valid"], "sft_success": c["success"] >= p["success"], "sft_static": c["static"] >= 0.98 * p["static"], "sft_claims": c["claims"] <= p["claims"], "sft_medium": F.coalesce(c["medium"] > p["medium"], F.lit(False)), "sft_long": F.coalesce(c["long"] > p["long"], F.lit(False)),
        "rl_success": c["success"] - p["success"] >= 0.03, "rl_length": c["tokens"] <= 1.1 * p["tokens"], "rl_loops": c["loops"] <= 1.1 * p["loops"], "four_bit": (lost <= 0.01) & (c["valid"] >= p["valid"]), "three_bit": lost <= 0.02, "two_bit": lost <= 0.05, "one_bit": F.lit(False),
    }
    return both.select(*[v.alias(k) for k, v in gates.items()])


@query(f"WITH {CALLS} SELECT count(*) AS calls, count(*) FILTER (looped) AS repeats, round(count(*) FILTER (looped) / count(*), 6) AS loop_rate FROM d")
def win_loops_without_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: the same action on equivalent arguments without progress."""
    return calls(spark, sf_dir).agg(F.count("*").alias("calls"), F.count_if("looped").alias("repeats"), F.round(F.count_if("looped") / F.count("*"), 6).alias("loop_rate"))


@query("SELECT source, lang, n_chars // 500 AS size, arg_max(doc_id, (quality - toxic, doc_id)) AS chosen, arg_min(doc_id, (quality - toxic, doc_id)) AS rejected, CAST(max(quality - toxic) - min(quality - toxic) AS DOUBLE) AS margin FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 > 0 GROUP BY 1, 2, 3 HAVING max(quality - toxic) - min(quality - toxic) > 0.5")
def cmp_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-21: of each state the clearest winner and loser, if their rewards
    differ by more than a margin; closer pairs are ambiguous and left out,
    failed infrastructure too.  One pair a state, by a pre-aggregated groupBy,
    so a state with many attempts costs no pairs of all of them."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("doc_id % 7 > 0")
    reward = F.col("quality") - F.col("toxic")
    order = F.struct(reward, "doc_id")
    best = rows.groupBy("source", "lang", F.floor(F.col("n_chars") / 500).alias("size")).agg(F.max_by("doc_id", order).alias("chosen"), F.min_by("doc_id", order).alias("rejected"), (F.max(reward) - F.min(reward)).cast("double").alias("margin"))
    return best.where("margin > 0.5")


HELD = "SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0 AND doc_id % 5 = 0"


@query(f"SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE source NOT IN ({HELD}) GROUP BY source")
def jon_exclude_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10: families of the evaluation do not occur in training."""
    held = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").where("toxic = 1 and quality = 0 and doc_id % 5 = 0").select(F.col("source").alias("family"))
    return J.excluded(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", held).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT string_agg(source, ',' ORDER BY source) AS families, count(*) AS n FROM (SELECT DISTINCT source FROM documents)")
def agg_sorted_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: the distinct families, sorted, as one list; there are few."""
    return table(spark, sf_dir, "documents").select("source").distinct().agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("families"), F.count("*").alias("n"))
