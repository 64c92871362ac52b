"""Rules of answers, rewards, paths, keys and schemas, on rows that are derived
from the given tables: an event's number k, its user and its value stand for
what a completion or an environment holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rewards as R
from ..sources.readers import from_rows
from .registry import query, table

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])


@query(f"""SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN max({K}) > 97 OR max(value) > 400 THEN 0.0 ELSE round(greatest(0, 0.2 * (bool_or(event_type = 'signup') AND bool_or(event_type = 'view'))::INT + 0.8 * bool_or(event_type = 'purchase')::INT - 0.05 * count(*) FILTER (event_type = 'error')), 6) END::DOUBLE AS reward FROM events GROUP BY 1, 2""")
def cmp_reward_toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-09: an episode's reward from its visible and hidden tests and tool
    errors; tests that were changed, or an error, are worth nothing."""
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    runs = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(has("signup").alias("visible"), has("view").alias("ran"), has("purchase").alias("hidden"), F.count_if(F.col("event_type") == "error").alias("tool_errors"), F.when(F.max("k") > 97, "changed").otherwise("kept").alias("digest"), (F.max("value") > 400).alias("errored"))
    reward = R.toy(*[F.col(c) for c in ("visible", "ran", "hidden", "tool_errors", "digest")], F.lit("kept"), F.col("errored"))
    return runs.select("user_id", "day", F.round(reward, 6).cast("double").alias("reward"))


@query("SELECT user_id, round(p, 6) AS p, n, round(power(p, n), 6) AS all_correct FROM (SELECT CAST(user_id AS BIGINT) AS user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM events GROUP BY user_id)")
def cmp_compounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-26: the chance that every step of a user's run is right, if steps
    are independent and each is as reliable as the user's were."""
    p = events(spark, sf_dir).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.avg((F.col("event_type") != "error").cast("double")).alias("p"), F.count("*").alias("n"))
    return p.select("user_id", F.round("p", 6).alias("p"), "n", F.round(F.pow("p", "n"), 6).alias("all_correct"))


_ANSWER = f"CASE event_type WHEN 'click' THEN '  ' || {K} || ' ' WHEN 'view' THEN chr(160) || '-' || value || chr(9) WHEN 'purchase' THEN {K} || ',000' WHEN 'signup' THEN '1e' || {K} WHEN 'error' THEN {K} || ' apples' END"


@query(f"SELECT event_id, answer FROM (SELECT event_id, {_ANSWER} AS answer FROM events) WHERE regexp_matches(replace(trim(answer, ' ' || chr(160) || chr(9)), ',', ''), '^-?[0-9]+(\\.[0-9]+)?$')")
def flt_numeric_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: answers that are one number, whatever space surrounds it and
    with commas or without; exponents and units are none."""
    k, kind = F.col("k").cast("string"), F.col("event_type")
    answer = F.when(kind == "click", F.concat(F.lit("  "), k, F.lit(" "))).when(kind == "view", F.concat(F.lit(" -"), F.col("value").cast("string"), F.lit("\t"))).when(kind == "purchase", F.concat(k, F.lit(",000"))).when(kind == "signup", F.concat(F.lit("1e"), k)).when(kind == "error", F.concat(k, F.lit(" apples")))
    return events(spark, sf_dir).select("event_id", answer.alias("answer")).where(T.bare_number(F.col("answer")))


@query(f"SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN {K} <= 50 THEN event_type END, 'user', CASE WHEN {K} % 3 = 0 THEN 'tokens' || 'x' END], lambda x: x IS NOT NULL AND NOT regexp_matches(upper(x), 'TOKEN|SECRET|PASSWORD|CREDENTIAL'))), ',') AS kept FROM events")
def flt_secret_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06/08: environments without null values and without keys that name
    a token, a secret, a password or a credential, in any case."""
    null = F.lit(None).cast("string")
    env = F.create_map(F.col("event_type"), F.when(F.col("k") <= 50, F.col("props")), F.concat("event_type", F.lit("_Secret")), F.lit("x"), F.lit("DB_PASSWORD"), F.col("props"), F.lit("user"), F.col("user_id").cast("string"), F.lit("tokensx"), F.when(F.col("k") % 3 == 0, "t").otherwise(null), F.lit("credentials"), null)
    safe = F.map_filter(env, lambda k, v: v.isNotNull() & ~F.upper(k).rlike("TOKEN|SECRET|PASSWORD|CREDENTIAL"))
    return events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.map_keys(safe)), ",").alias("kept"))


@query("SELECT name, expected, observed FROM (SELECT n_name AS name, count(*)::VARCHAR AS expected FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) FULL JOIN (SELECT n_name AS name, count(*)::VARCHAR AS observed FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) USING (name) WHERE expected IS DISTINCT FROM observed")
def gate_pin_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GATE-07: what is pinned against what is found, by name (here how many
    customers and suppliers a nation has): pins that differ, that are missing
    and that nobody expected."""
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")))  # 25 rows
    of = lambda t, key, word: table(spark, sf_dir, t).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").cast("string").alias(word)).join(nations, "n_nationkey").select("name", word)
    want, have = of("customer", "c_nationkey", "expected"), of("supplier", "s_nationkey", "observed")
    return want.join(have, "name", "full").where(~F.col("expected").eqNullSafe(F.col("observed")))


@query("SELECT role, most, count(*) AS turns, count(*) FILTER (length(text) > most) AS over FROM conversations JOIN (VALUES ('user', 200), ('assistant', 400), ('system', NULL)) t(role, most) USING (role) GROUP BY role, most")
def src_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: rows in memory under a declared schema, a limit for each role,
    and the turns that they are about."""
    limits = from_rows(spark, [{"role": "user", "most": 200}, {"most": 400, "role": "assistant"}, {"role": "system", "most": None}], "role string, most int")
    rows = table(spark, sf_dir, "conversations").select("role", F.char_length("text").alias("n")).join(F.broadcast(limits), "role")  # three rows
    return rows.groupBy("role", "most").agg(F.count("*").alias("turns"), F.count_if(F.col("n") > F.col("most")).alias("over"))


_TOOLS = "VALUES ('click','path'),('view','path'),('purchase','query'),('signup','profile')"


@query(f"SELECT event_id, CASE WHEN {K} >= 50 THEN coalesce(argument, '') ELSE '' END AS missing, 'k' AS unknown FROM events LEFT JOIN ({_TOOLS}) t(name, argument) ON event_type = name")
def set_required_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03/04: of every call the required arguments that are missing and
    the given ones that its tool does not know, as set differences."""
    specs = F.broadcast(spark.sql(f"SELECT name, argument FROM {_TOOLS} t(name, argument)"))
    rows = events(spark, sf_dir).join(specs, F.col("event_type") == F.col("name"), "left")
    need = F.when(F.col("argument").isNotNull(), F.array("argument")).otherwise(F.array().cast("array<string>"))
    sent = F.when(F.col("argument").isNotNull() & (F.col("k") < 50), F.concat(F.lit('{"'), "argument", F.lit('":1,'), F.substring("props", 2, 100))).otherwise(F.col("props"))
    given = F.json_object_keys(sent)
    return rows.select("event_id", F.array_join(F.array_except(need, given), ",").alias("missing"), F.array_join(F.array_except(given, need), ",").alias("unknown"))


@query(f"""SELECT event_id, '{{"name":"' || event_type || '","parameters":{{"limits":[null,' || {K} || ',{{"a":true}}],"properties":{{"' || event_type || '":{{"type":"string"}},"z":{{}}}},"required":["z","' || event_type || '"]}},"said":"a \\"k\\":null, }}"}}' AS canonical FROM events""")
def fn_canonical_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-01/02: tool declarations that come with padding, in any order and
    with members of every type become one text: null members go at each depth,
    null elements of lists and everything inside strings stay."""
    kind, k = F.col("event_type"), F.col("k").cast("string")
    order = F.col("k") % 2 == 0
    said = F.lit('"said" : "a \\"k\\":null, }"')
    parameters = F.concat(F.lit('"parameters": {"required": ["z", "'), kind, F.lit('"], "x": null, "properties": {"z": {"enum": null}, "'), kind, F.lit('": {"type": "string", "format": null}}, "limits": [null, '), k, F.lit(', {"b": null, "a": true}]}'))
    name = F.concat(F.lit('"strict":null, "name": "'), kind, F.lit('"'))
    made = F.when(order, F.concat(F.lit("{"), said, F.lit(", "), parameters, F.lit(",\n"), name, F.lit("}"))).otherwise(F.concat(F.lit("{ "), name, F.lit(","), parameters, F.lit(" ,"), said, F.lit(',"end":null}')))
    return events(spark, sf_dir).select("event_id", T.canonical_json(made).alias("canonical"))


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'only ' || user_id WHEN 3 THEN '' ELSE 'sum' END AS reasoning, CASE event_id % 4 WHEN 1 THEN 'that makes ' || user_id || ',000 apples' WHEN 2 THEN '' ELSE user_id::VARCHAR END AS reply,
    CAST(CASE event_id % 4 WHEN 2 THEN -0.5 WHEN 3 THEN 1.0 ELSE 1.5 END AS DOUBLE) AS format, CAST(CASE event_id % 4 WHEN 1 THEN 0.25 WHEN 2 THEN -0.5 ELSE 1.0 END AS DOUBLE) AS is_number, CAST(CASE WHEN event_id % 4 = 2 THEN -0.5 WHEN event_id % 4 = 1 AND {K} <> user_id THEN -0.5 ELSE 4.0 END AS DOUBLE) AS correct FROM events""")
def cmp_rewards_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-20/21, CMP-11/12/13: channels of completions and the three rewards
    on them; numbers among words count little, the last one is compared."""
    n, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    reply = F.when(k == 1, F.concat(F.lit("that makes "), n, F.lit(",000 apples"))).otherwise(n)
    text = F.when(k == 2, F.concat(F.lit("only "), n)).otherwise(F.concat(F.when(k == 3, "").otherwise(" to=self<|message|>sum<|eom|>"), F.lit("<|start|>assistant to=user<|message|>"), reply, F.lit("<|eot|>")))
    gold = F.when(k == 1, F.concat(F.col("k").cast("string"), F.lit("000"))).otherwise(n)
    reasoning, answer = T.split_channels(F.col("completion"))
    rows = events(spark, sf_dir).select("event_id", text.alias("completion"), gold.alias("gold"))
    number = lambda c: c.cast("double")
    return rows.select("event_id", reasoning.alias("reasoning"), answer.alias("reply"), number(R.channel_format(F.col("completion"))).alias("format"), number(R.number_format(F.col("completion"))).alias("is_number"), number(R.number_correct(F.col("completion"), F.col("gold"))).alias("correct"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN -2 ELSE 1 END AS DOUBLE) AS format, CAST(CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS DOUBLE) AS correct, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS solutions FROM events")
def fn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22, CMP-14/15: delimited spans and their rewards: one of each kind,
    two solutions, gibberish, and a wrong solution alone."""
    n, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("<REASONING>"), "event_type", F.lit("\n</REASONING>\n<SOLUTION>\n"), n, F.lit("\n</SOLUTION>")))
        .when(k == 1, F.concat(F.lit("<REASONING></REASONING><SOLUTION>"), n, F.lit("</SOLUTION><SOLUTION>"), n, F.lit("</SOLUTION>")))
        .when(k == 2, F.lit("addCriterion\n\n\nok"))
        .otherwise(F.concat(F.lit("<SOLUTION>not "), n, F.lit("</SOLUTION>")))
    )
    rows = events(spark, sf_dir).select("event_id", text.alias("completion"), n.alias("answer"))
    return rows.select("event_id", R.span_format(F.col("completion")).cast("double").alias("format"), R.span_correct(F.col("completion"), F.col("answer")).cast("double").alias("correct"), F.size(T.spans(F.col("completion"), *R.SOLUTION)).alias("solutions"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 5 THEN true ELSE false END AS inside FROM documents")
def fn_path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12: paths that leave their root: plain ones, ones that turn back
    inside, ones that go above it at once or on the way, and absolute ones."""
    k, own = F.col("doc_id") % 6, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    path = F.when(k == 0, own).when(k == 1, F.concat(own, F.lit("/../../"), "lang", F.lit("/./x"))).when(k == 2, F.concat(F.lit("../"), own)).when(k == 3, F.concat(own, F.lit("/../../../"), own)).when(k == 4, F.concat(F.lit("/"), own)).otherwise(F.concat(F.lit("./"), own, F.lit("/..")))
    return table(spark, sf_dir, "documents").select("doc_id", T.inside_root(path).alias("inside"))
