"""Trajectories built from the conversation table: rendering with tools,
thoughts and calls, preference rows, audits and exploded calls.

A conversation's assistant turns think their turn number; those with an odd
turn call read_file, and the next message is the tool's answer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import foreign as X
from ..functions import messages as M
from ..functions import text as T
from ..operators.split import seeded_split
from ..operators.validate import require_valid, validate
from ..sources.scratch import stored
from .registry import WORDS, query, table

TOOL_LINES = [json.dumps(t) for t in M.tools()[:2]]
#: The same rows in DuckDB: role, content, thought and the called path of each message.
TALK = """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' AND turn % 2 = 1 THEN 'developer' WHEN role = 'user' AND lag(role = 'assistant' AND turn % 2 = 1) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'tool' ELSE role END AS role, text AS content,
        CASE WHEN role = 'assistant' THEN 'turn ' || turn END AS thought, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'src/' || turn END AS path FROM conversations)"""
QUOTED = "'<tools>' || chr(10) || '" + "' || chr(10) || '".join(x.replace("'", "''") for x in TOOL_LINES) + "' || chr(10) || '</tools>'"
RENDERED = f"""{TALK}, o AS (SELECT *, coalesce(min(CASE WHEN role NOT IN ('system', 'developer') THEN turn END) OVER (PARTITION BY conv_id), 1000000) AS other FROM t),
    h AS (SELECT conv_id, {QUOTED} || coalesce(chr(10) || chr(10) || nullif(string_agg(content, chr(10) || chr(10) ORDER BY turn) FILTER (turn < other), ''), '') AS system FROM o GROUP BY conv_id),
    b AS (SELECT conv_id, string_agg('<|im_start|>' || CASE role WHEN 'tool' THEN 'user' ELSE role END || chr(10) || CASE role
        WHEN 'tool' THEN '<tool_response>' || chr(10) || content || chr(10) || '</tool_response>'
        WHEN 'assistant' THEN '<think>' || chr(10) || thought || chr(10) || '</think>' || chr(10) || chr(10) || content || CASE WHEN path IS NULL THEN '' ELSE CASE WHEN content = '' THEN '' ELSE chr(10) END || '<tool_call>' || chr(10) || '<function=read_file>' || chr(10) || '<parameter=path>' || chr(10) || path || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>' END
        ELSE content END || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body FROM o WHERE turn >= other GROUP BY conv_id),
    r AS (SELECT conv_id, '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) || coalesce(body, '') AS text FROM h LEFT JOIN b USING (conv_id))"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) with calls, answers and thoughts."""
    none = lambda kind: F.lit(None).cast(kind)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))

    def message(m: Column, i: Column) -> Column:
        before = F.get(F.col("m"), i - 1)
        odd, spoken = m["turn"] % 2 == 1, m["role"] == "assistant"
        answer = (m["role"] == "user") & F.coalesce((before["role"] == "assistant") & (before["turn"] % 2 == 1), F.lit(False))
        role = F.when((m["role"] == "system") & odd, "developer").when(answer, "tool").otherwise(m["role"])
        path = F.concat(F.lit("src/"), m["turn"].cast("string"))
        call = F.struct(none("string").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("read_file").alias("name"), F.create_map(F.lit("path"), path).alias("arguments")).alias("function"))
        thought = F.when(spoken, F.concat(F.lit("turn "), m["turn"].cast("string")))
        return F.struct(role.alias("role"), m["text"].alias("content"), thought.alias("reasoning_content"), F.when(answer, "read_file").alias("name"), none("string").alias("tool_call_id"), F.when(spoken & odd, F.array(call)).alias("tool_calls"))

    return turns.select("conv_id", F.transform("m", message).cast(f"array<{M.MESSAGE}>").alias("messages"))


def _tools() -> Column:
    return F.array(*map(F.lit, TOOL_LINES))


@query(f"{RENDERED} SELECT conv_id, '{M.SCHEMA_VERSION}' AS schema_version, text, {WORDS} AS tokens FROM r")
def cmp_render_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-02, FN-04/05, PRJ-06: whole trajectories rendered with tools,
    thoughts, calls and answers, measured and stamped."""
    rows = trajectories(spark, sf_dir).select("conv_id", F.lit(M.SCHEMA_VERSION).alias("schema_version"), M.render_chat(F.col("messages"), _tools()).alias("text"))
    return rows.withColumn("tokens", T.word_count(F.col("text")))


@query(f"{TALK} SELECT conv_id, count(path) AS calls, coalesce(string_agg(path, ',' ORDER BY turn) FILTER (path IS NOT NULL), '') AS paths, true AS same_tools FROM t GROUP BY conv_id")
def fn_render_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-03/05/07: what is rendered is read back, calls and declarations."""
    rows = trajectories(spark, sf_dir).withColumn("text", M.render_chat(F.col("messages"), _tools()))
    spoken = F.filter(F.split("text", r"<\|im_start\|>"), lambda x: x.startswith("assistant\n"))
    calls = F.flatten(F.transform(spoken, M.parse_tool_calls))
    want = M.canonical(M.tools()[:2])
    return rows.select("conv_id", F.size(calls).cast("long").alias("calls"), F.array_join(F.transform(calls, lambda c: c["arguments"]["path"]), ",").alias("paths"), (M.rendered_tools(F.col("text")) == want).alias("same_tools"))


@query(f"{TALK} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 'read_file' AS name, path FROM t WHERE path IS NOT NULL")
def udf_calls_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-05, WIN-03: one row for each call, with its number in the
    conversation."""
    rows = trajectories(spark, sf_dir).select("conv_id", F.flatten(F.transform("messages", lambda m: F.coalesce(m["tool_calls"], F.array().cast(M.CALLS)))).alias("calls"))
    return rows.select("conv_id", F.posexplode("calls").alias("position", "call")).select("conv_id", F.col("position").cast("long").alias("position"), F.col("call.function.name").alias("name"), F.col("call.function.arguments")["path"].alias("path"))


@query(
    f"""{TALK}, p AS (SELECT conv_id, turn, role, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t)
    SELECT conv_id, i AS position, role, length(content) AS chars FROM p"""
)
def win_message_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: every message with its position."""
    return trajectories(spark, sf_dir).select("conv_id", F.posexplode("messages").alias("position", "m")).select("conv_id", F.col("position").cast("long").alias("position"), "m.role", F.char_length("m.content").cast("long").alias("chars"))



@query(
    """SELECT item_id, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS prompt,
        'short' || chr(10) || '</think>' || chr(10) || chr(10) || 'yes ' || item_id || '<|im_end|>' || chr(10) AS chosen, chr(10) || '</think>' || chr(10) || chr(10) || 'no<|im_end|>' || chr(10) AS rejected FROM benchmark WHERE item_id % 3 > 0"""
)
def cmp_render_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-04, FN-10, GATE-05: prompt and both completions of every preferred
    pair; rows that are no preference are filtered before they are rendered."""
    none = F.lit(None).cast("string")
    message = lambda role, content, thought=none: F.struct(F.lit(role).alias("role"), content.alias("content"), thought.alias("reasoning_content"), none.alias("name"), none.alias("tool_call_id"), F.lit(None).cast(M.CALLS).alias("tool_calls"))
    rows = table(spark, sf_dir, "benchmark").where("item_id % 3 > 0")
    made = M.preference(F.array(message("user", F.col("text"))), message("assistant", F.concat(F.lit("yes "), F.col("item_id").cast("string")), F.lit("short")), message("assistant", F.lit("no")), (F.col("item_id") % 3).cast("double"), F.lit(0.0), F.lit("ok"))
    return rows.select("item_id", made.alias("p")).select("item_id", "p.*")


@query("SELECT item_id, CASE WHEN item_id % 2 = 1 THEN 'answer ' || item_id END AS completion, item_id % 2 = 0 AS drifted FROM benchmark")
def fn_prefix_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-10: rows whose full text does not begin with their prompt are told
    apart before they would fail the job."""
    full = F.concat(F.when(F.col("item_id") % 2 == 0, F.lit(" ")).otherwise(""), "text", F.lit("answer "), F.col("item_id").cast("string"))
    rows = table(spark, sf_dir, "benchmark").withColumn("full", full).withColumn("drifted", ~F.col("full").startswith(F.col("text")))
    return rows.select("item_id", F.when(~F.col("drifted"), M.after_prefix(F.col("full"), F.col("text"))).alias("completion"), "drifted")


@query(
    f"""{TALK}, s AS (SELECT conv_id, string_agg(role || chr(10) || content, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS text, count(*) FILTER (role = 'assistant') AS n, max(content) FILTER (role = 'user') AS asked, arg_max(content, turn) FILTER (role = 'assistant') AS answer FROM t GROUP BY conv_id)
    SELECT conv_id, n > 0 AS any_trained, true AS nothing_before, contains(coalesce(text, ''), coalesce(answer, '?')) AS answer, NOT contains(coalesce(text, ''), coalesce(asked, '?')) AS no_observation, length(coalesce(text, '')) AS chars FROM s"""
)
def cmp_supervision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-18, AGG-11, FN-27: the four conditions on what is trained on."""
    of = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    rows = trajectories(spark, sf_dir)
    audit = M.supervision(F.col("messages"), F.coalesce(F.get(F.reverse(of("assistant")), F.lit(0)), F.lit("?")), F.coalesce(F.array_max(of("user")), F.lit("?")))
    return rows.select("conv_id", audit.alias("a")).select("conv_id", "a.any_trained", "a.nothing_before", "a.answer", "a.no_observation", F.char_length("a.text").cast("long").alias("chars"))


@query("SELECT conv_id, '<|im_start|>system' || chr(10) || 'Reasoning effort: ' || CASE conv_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'xhigh' END || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || arg_min(text, turn) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def udf_row_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-06: options of the template that travel with the row as a map."""
    none = F.lit(None).cast("string")
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    effort = F.when(F.col("conv_id") % 3 == 0, "low").when(F.col("conv_id") % 3 == 1, "medium").otherwise("xhigh")
    options = F.create_map(F.lit("reasoning_effort"), effort, F.lit("enable_thinking"), F.when(F.col("conv_id") % 2 == 0, "false").otherwise("true"))
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), none.alias("reasoning_content"), none.alias("name"), none.alias("tool_call_id"), F.lit(None).cast(M.CALLS).alias("tool_calls"))
    return first.select("conv_id", M.render_chat(F.array(message), generation_prompt=True, options=options).alias("prompt"))


@query("SELECT item_id, CASE WHEN ('0x' || substr(sha256('s2' || item_id), 1, 8))::BIGINT < CASE WHEN (SELECT count(*) FROM benchmark) < 20 THEN 2147483648 ELSE 429496729 END THEN 'test' ELSE 'train' END AS split FROM benchmark")
def win_seeded_small_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: a tenth for test, half of a small table."""
    return seeded_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "s2")


@query(f"{TALK} SELECT conv_id, count(*) AS n_messages, count(path) AS n_calls, count(DISTINCT role) AS roles FROM t GROUP BY conv_id")
def prj_all_but_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05: a report row is the trajectory without its messages."""
    rows = trajectories(spark, sf_dir)
    made = F.filter("messages", lambda m: F.size(m["tool_calls"]) > 0)
    return rows.withColumns({"n_messages": F.size("messages").cast("long"), "n_calls": F.size(made).cast("long"), "roles": F.size(F.array_distinct(F.transform("messages", lambda m: m["role"]))).cast("long")}).drop("messages")


@query(f"{TALK}, z AS (SELECT conv_id, path, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t WHERE path IS NOT NULL), a AS (SELECT conv_id, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t WHERE role = 'tool') SELECT conv_id, CAST(r AS BIGINT) AS r, path, length(content) AS answer_chars FROM z LEFT JOIN a USING (conv_id, r)")
def jon_zip_calls_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05: the list of calls and the list of answers, pair by pair; the
    longer list's rest stays without a partner."""
    rows = trajectories(spark, sf_dir)
    paths = F.transform(F.filter("messages", lambda m: F.size(m["tool_calls"]) > 0), lambda m: F.get(m["tool_calls"], F.lit(0))["function"]["arguments"]["path"])
    answers = F.transform(F.filter("messages", lambda m: m["role"] == "tool"), lambda m: F.char_length(m["content"]).cast("long"))
    pairs = F.zip_with(paths, answers, lambda p, a: F.struct(p.alias("path"), a.alias("answer_chars")))
    return rows.select("conv_id", F.posexplode(pairs).alias("r", "x")).select("conv_id", (F.col("r") + 1).cast("long").alias("r"), "x.path", "x.answer_chars")


#: Characters of a completion; what is longer was cut while it was written.
COMPLETION = 400
_CALL_TEXT = "chr(10) || '<tool_call>' || chr(10) || '<function=read_file>' || chr(10) || '<parameter=path>' || chr(10) || path || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'"
_FULL = f"'<think>' || chr(10) || thought || chr(10) || '</think>' || chr(10) || chr(10) || content || coalesce({_CALL_TEXT}, '')"
#: Every assistant turn: what was written of it, what it called, what came back.
COMPLETIONS_SQL = f"""{TALK}, w AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(content) OVER (PARTITION BY conv_id ORDER BY turn) AS next_content FROM t)
    SELECT conv_id, turn, path, content, thought, left({_FULL}, {COMPLETION}) AS raw, length({_FULL}) AS full_length, CASE WHEN next_role = 'tool' THEN next_content END AS recorded FROM w WHERE role = 'assistant'"""
REPLAYED_SQL = f"SELECT conv_id, turn, full_length <= {COMPLETION} AS parsed, full_length <= {COMPLETION} AND recorded IS NOT NULL AS same FROM ({COMPLETIONS_SQL}) WHERE path IS NOT NULL"


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, path, raw, recorded): every assistant turn as it was
    written, the path that it meant to read and the answer on record."""
    rows = trajectories(spark, sf_dir).withColumn("m", F.transform("messages", lambda m, i: F.struct(m.alias("m"), F.get(F.col("messages"), i + 1).alias("next"))))
    m = F.col("x.m")
    call = F.get(m["tool_calls"], F.lit(0))
    full = F.concat(F.lit("<think>\n"), m["reasoning_content"], F.lit("\n</think>\n\n"), m["content"], F.coalesce(F.concat(F.lit("\n"), M.rendered_call(call)), F.lit("")))
    spoken = rows.select("conv_id", F.explode("m").alias("x")).where(m["role"] == "assistant")
    turn = F.regexp_extract(m["reasoning_content"], "[0-9]+", 0).cast("long")
    return spoken.select("conv_id", turn.alias("turn"), call["function"]["arguments"]["path"].alias("path"), F.left(full, F.lit(COMPLETION)).alias("raw"), F.when(F.col("x.next.role") == "tool", F.col("x.next.content")).alias("recorded"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, parsed, same) of every call: whether it can be read
    from what was written, and whether the file that it names now answers as
    it did.  The files are what the tools answered, by conversation and path;
    calls are parsed, looked up by a join and compared."""
    made = completions(spark, sf_dir).where("path is not null")
    found = made.select("conv_id", "turn", "recorded", F.get(M.parse_tool_calls(F.col("raw")), F.lit(0)).alias("call"))
    tree = made.where("recorded is not null").select(F.col("conv_id").alias("_conv"), F.col("path").alias("_path"), F.col("recorded").alias("now"))
    asked = found.withColumn("path", F.when(F.col("call.name") == "read_file", F.col("call.arguments")["path"]))
    same = F.coalesce(F.col("now") == F.col("recorded"), F.lit(False))
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("path") == F.col("_path"))  # no filter for one side alone, so conversations are shuffled once
    return asked.join(tree, here, "left").select("conv_id", "turn", F.col("path").isNotNull().alias("parsed"), same.alias("same"))


@query(f"SELECT lane, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(sum(calls) AS BIGINT) AS calls, round(sum(replays) / nullif(sum(calls), 0), 6) AS replay_rate FROM (SELECT conv_id, calls, replays, CASE WHEN calls = 0 THEN 'non_agentic' WHEN parses < calls THEN 'reject' WHEN replays < calls THEN 'regenerable' ELSE 'native' END AS lane FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, count(*) AS c, count(*) FILTER (parsed) AS p, count(*) FILTER (same) AS s FROM ({REPLAYED_SQL}) GROUP BY conv_id) USING (conv_id), LATERAL (SELECT coalesce(c, 0) AS calls, coalesce(p, 0) AS parses, coalesce(s, 0) AS replays)) GROUP BY lane")
def cmp_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-19: conversations in four lanes, their shares, and how many of
    their calls replay: without calls, with calls that do not parse, with
    answers that cannot be had again, and native ones."""
    per = replayed(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("c"), F.count_if("parsed").alias("p"), F.count_if("same").alias("s"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().join(per, "conv_id", "left").fillna(0, ["c", "p", "s"])
    lane = F.when(F.col("c") == 0, "non_agentic").when(F.col("p") < F.col("c"), "reject").when(F.col("s") < F.col("c"), "regenerable").otherwise("native")
    lanes = rows.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"), F.sum("c").alias("calls"), F.round(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), 6).alias("replay_rate"))
    return lanes.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)).select("lane", "n", "share", "calls", "replay_rate")  # four rows


@query(f"SELECT conv_id, turn, CASE WHEN conv_id % 5 = 2 THEN '' ELSE thought END AS reasoning, length(regexp_replace(CASE WHEN conv_id % 5 = 2 THEN content ELSE substr(raw, strpos(raw, '</think>') + 8) END, '^\\s+|\\s+$', '', 'g')) AS n FROM ({COMPLETIONS_SQL})")
def fn_split_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-06: reasoning before the first closing tag of every completion;
    those of every fifth conversation have no tag, and so no reasoning."""
    rows = completions(spark, sf_dir)
    raw = F.when(F.col("conv_id") % 5 == 2, F.concat(F.lit(" \t"), F.col("full"), F.lit("\n"))).otherwise(F.col("raw"))
    plain = trajectories(spark, sf_dir).select("conv_id", F.explode("messages").alias("m")).where("m.role = 'assistant'").select("conv_id", F.regexp_extract("m.reasoning_content", "[0-9]+", 0).cast("long").alias("turn"), F.col("m.content").alias("full"))
    reasoning, content = T.split_reasoning(raw)
    return rows.join(plain, ["conv_id", "turn"]).select("conv_id", "turn", reasoning.alias("reasoning"), F.char_length(content).cast("long").alias("n"))


@query(f"SELECT conv_id, turn, CASE WHEN full_length <= {COMPLETION} THEN 'read_file' ELSE '' END AS names, CASE WHEN full_length <= {COMPLETION} THEN 'path=' || path ELSE '' END AS arguments, contains(raw, '<tool_call>') AND full_length > {COMPLETION} AS malformed FROM ({COMPLETIONS_SQL}) WHERE path IS NOT NULL")
def fn_parse_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-07: calls with their arguments from what was written; one that was
    cut inside its tags is flagged as malformed."""
    rows = completions(spark, sf_dir).where("path is not null").withColumn("calls", M.parse_tool_calls(F.col("raw")))
    shown = F.transform("calls", lambda c: F.array_join(F.transform(F.map_entries(c["arguments"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))
    return rows.select("conv_id", "turn", F.array_join(F.transform("calls", lambda c: c["name"]), ";").alias("names"), F.array_join(shown, ";").alias("arguments"), M.malformed_call(F.col("raw")).alias("malformed"))


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as rows of a training set, seven of eight kinds of
    conversation spoilt, each in another way, with their errors."""
    kind = F.col("conv_id") % 8
    empty = F.create_map().cast("map<string,string>")

    def spoilt(m: Column) -> Column:
        def call(c: Column) -> Column:
            given = c["function"]["arguments"]
            arguments = F.when(kind == 2, empty).when(kind == 3, F.map_concat(given, F.create_map(F.lit("mode"), F.lit("r")))).when(kind != 6, given)
            return c.withField("function", F.struct(F.when(kind == 1, "bash").otherwise(c["function"]["name"]).alias("name"), arguments.alias("arguments")))

        return m.withField("tool_calls", F.transform(m["tool_calls"], call)).withField("name", F.when((kind == 4) & (m["role"] == "tool"), "search").otherwise(m["name"]))

    want = M.canonical(M.tools())
    rows = trajectories(spark, sf_dir).withColumns({
        "version": F.when(kind == 5, "v0").otherwise(M.SCHEMA_VERSION), "stored": F.when(kind == 7, "[]").otherwise(want),
        "declared": F.from_json(F.when(kind != 7, want), M.TOOLS), "verified": kind != 5, "messages": F.transform("messages", spoilt),
    })
    return rows.withColumn("errors", validate(F.col("version"), F.col("stored"), M.fingerprint(F.col("declared")), F.col("messages"), F.col("verified")))


ERRORS_SQL = f"""{TALK}, p AS (SELECT *, conv_id % 8 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t),
    q AS (SELECT *, coalesce(sum(CASE WHEN kind NOT IN (1, 6) THEN (path IS NOT NULL)::INT - (role = 'tool')::INT ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pending FROM p),
    e AS (SELECT conv_id, i, 1 AS k, 'turn_before_response' AS code FROM q WHERE role = 'assistant' AND pending > 0
        UNION ALL SELECT conv_id, i, 2, CASE kind WHEN 1 THEN 'unknown_tool' WHEN 2 THEN 'missing_argument' WHEN 3 THEN 'unknown_argument' ELSE 'arguments_not_mapping' END FROM q WHERE path IS NOT NULL AND kind IN (1, 2, 3, 6)
        UNION ALL SELECT conv_id, i, 1, CASE WHEN pending = 0 THEN 'response_without_call' ELSE 'wrong_response_name' END FROM q WHERE role = 'tool' AND (pending = 0 OR kind = 4)
        UNION ALL SELECT conv_id, i, 1, 'unresolved_responses' FROM q WHERE role NOT IN ('assistant', 'tool') AND pending > 0
        UNION ALL SELECT conv_id, -3, 1, 'schema_version' FROM q WHERE kind = 5 AND i = 0
        UNION ALL SELECT conv_id, -3, 1, 'schema_json' FROM q WHERE kind = 7 AND i = 0 UNION ALL SELECT conv_id, -2, 1, 'tools_differ' FROM q WHERE kind = 7 AND i = 0
        UNION ALL SELECT conv_id, 1000000, 1, 'ends_unresolved' FROM p GROUP BY conv_id HAVING sum(CASE WHEN kind NOT IN (1, 6) THEN (path IS NOT NULL)::INT - (role = 'tool')::INT ELSE 0 END) > 0
        UNION ALL SELECT conv_id, 1000001, 1, 'no_tool_call' FROM p GROUP BY conv_id HAVING count(path) FILTER (kind NOT IN (1, 6)) = 0
        UNION ALL SELECT conv_id, 1000002, 1, 'not_verified' FROM q WHERE kind = 5 AND i = 0),
    v AS (SELECT conv_id, coalesce(string_agg(code || ':' || CASE WHEN i < 0 OR i >= 1000000 THEN -1 ELSE i END, ',' ORDER BY i, k), '') AS errors FROM (SELECT DISTINCT conv_id FROM t) LEFT JOIN e USING (conv_id) GROUP BY conv_id)"""


@query(f"{ERRORS_SQL} SELECT conv_id, errors FROM v")
def cmp_validate_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-01, GATE-04: every conversation as a trajectory under all rules; of
    eight kinds seven are spoilt, each in another way."""
    return _stamped(spark, sf_dir).select("conv_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["idx"].cast("string"))), ",").alias("errors"))


@query(f"{ERRORS_SQL} SELECT count(*) FILTER (errors = '') AS valid, count(*) FILTER (errors <> '') AS invalid, count(*) FILTER (errors <> '') > 0 AS refused, least(20, count(*) FILTER (errors <> '')) AS shown, (SELECT conv_id || ': ' || replace(replace(errors, ':', '@'), ',', ', ') FROM v WHERE errors <> '' ORDER BY conv_id LIMIT 1) AS first_shown FROM v")
def gate_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GATE-01: a set with invalid rows is refused with the first of them;
    without them it passes."""
    rows = stored(_stamped(spark, sf_dir).select("conv_id", "errors"))
    try:
        require_valid(rows, "errors", "conv_id")
        lines: list[str] = []
    except ValueError as e:
        lines = str(e).splitlines()[1:]
    passed = require_valid(rows.where(F.size("errors") == 0), "errors", "conv_id").count()
    return rows.agg(F.lit(passed).cast("long").alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"), F.lit(bool(lines)).alias("refused"), F.lit(len(lines)).cast("long").alias("shown"), F.lit(lines[0] if lines else None).cast("string").alias("first_shown"))


@query(f"{TALK} SELECT conv_id, string_agg(CASE WHEN conv_id % 3 = 1 THEN 'unknown_tool' ELSE 'read_file' END, ',' ORDER BY turn) AS names FROM t WHERE role = 'tool' GROUP BY conv_id")
def jon_name_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02: names of tool messages from the calls they answer, by id; in
    every third conversation the ids have no call."""

    def with_ids(m: Column, i: Column) -> Column:
        asked = F.get(F.get(F.col("messages"), i - 1)["tool_calls"], F.lit(0))["function"]["arguments"]["path"]
        calls = F.transform(m["tool_calls"], lambda c: c.withField("id", c["function"]["arguments"]["path"]))
        return m.withField("tool_calls", calls).withField("name", F.lit(None).cast("string")).withField("tool_call_id", F.when(m["role"] == "tool", F.when(F.col("conv_id") % 3 == 1, "lost").otherwise(asked)))

    rows = trajectories(spark, sf_dir).select("conv_id", M.backfill_names(F.transform("messages", with_ids)).alias("m"))
    answers = F.filter("m", lambda m: m["role"] == "tool")
    return rows.where(F.size(answers) > 0).select("conv_id", F.array_join(F.transform(answers, lambda m: m["name"]), ",").alias("names"))


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, raw): conversations in a foreign shape, as JSON: a head that
    declares the tool, thoughts in a field of their own (in two conversations
    of three), calls flat with arguments as a string or nested as an object."""
    none = lambda kind: F.lit(None).cast(kind)
    nested = F.col("conv_id") % 2 == 1
    head = F.lit('{"role":"system","tools":[{"name":"read_file","description":"d"}]}')

    def message(m: Column, i: Column) -> Column:
        call = F.get(m["tool_calls"], F.lit(0))["function"]["arguments"]
        asked = F.get(F.get(F.col("messages"), i - 1)["tool_calls"], F.lit(0))["function"]["arguments"]["path"]
        function = F.when(nested, F.struct(F.lit("read_file").alias("name"), call.alias("arguments")))
        made = F.struct(F.when(nested, call["path"]).alias("id"), F.when(~nested, call["path"]).alias("tool_call_id"), F.when(nested, "function").alias("type"), F.when(~nested, "read_file").alias("name"), F.when(~nested, F.to_json(call)).alias("arguments"), function.alias("function"))
        return F.to_json(F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(F.col("conv_id") % 3 > 0, m["reasoning_content"]).alias("think_fast"), F.when(m["role"] == "tool", asked).alias("tool_call_id"), F.when(call.isNotNull(), F.array(made)).alias("tool_calls"), none("string").alias("name")))

    texts = F.concat(F.array(head), F.transform("messages", message))
    return trajectories(spark, sf_dir).select("conv_id", F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("raw"))


_KEPT = "conv_id IN (SELECT conv_id FROM t WHERE role = 'assistant') AND conv_id % 3 > 0"
_MERGED = "CASE WHEN role = 'assistant' THEN '<think>' || thought || '</think>' || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END ELSE content END"
_PARAMETERS = '{"type":"object","properties":{}}'


@query(f"""{TALK} SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, arg_min({_MERGED}, turn) FILTER (role = 'assistant') AS content, coalesce(string_agg('read_file{{"path":"' || path || '"}}', ',' ORDER BY turn), '') AS calls, coalesce(string_agg('read_file', ',') FILTER (role = 'tool'), '') AS answered, 'read_file:{_PARAMETERS}' AS tools FROM t WHERE {_KEPT} GROUP BY conv_id""")
def cmp_foreign_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-05, FN-16 to FN-19, FLT-02/07: foreign rows prepared, whichever way
    their calls are written; those without thoughts are dropped."""
    rows = foreign(spark, sf_dir).withColumn("m", X.parse(F.col("raw"))).where(X.usable(F.col("m")))
    rows = rows.select("conv_id", X.prepare(F.col("m")).alias("p"), X.declared(F.col("m")).alias("t"))
    spoken, answers = F.filter("p", lambda m: m["role"] == "assistant"), F.filter("p", lambda m: m["role"] == "tool")
    made = F.flatten(F.transform("p", lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>"))))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("p", lambda m: m["role"]), "|").alias("roles"),
        F.get(spoken, F.lit(0))["content"].alias("content"),
        F.array_join(F.transform(made, lambda c: F.concat(c["name"], c["arguments"])), ",").alias("calls"),
        F.array_join(F.transform(answers, lambda m: m["name"]), ",").alias("answered"),
        F.array_join(F.transform("t", lambda t: F.concat_ws(":", t["name"], t["parameters"])), ",").alias("tools"),
    )


@query(
    f"""{TALK}, f AS (SELECT *, role = 'system' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS head FROM t)
    SELECT conv_id, '<|im_start|>system' || chr(10) || '<tools>' || chr(10) || '{{"name":"read_file","parameters":{_PARAMETERS}}}' || chr(10) || '</tools>' || coalesce(chr(10) || chr(10) || nullif(max(content) FILTER (head), ''), '') || '<|im_end|>' || chr(10)
        || coalesce(string_agg('<|im_start|>' || role || chr(10) || {_MERGED} || coalesce(chr(10) || '<tool_call>' || chr(10) || '{{"name":"read_file","arguments":{{"path":"' || path || '"}}}}' || chr(10) || '</tool_call>', '') || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (NOT head), '') AS text
    FROM f WHERE {_KEPT} GROUP BY conv_id"""
)
def cmp_foreign_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-05: foreign rows prepared and rendered, a system text of their own
    behind the declared tools; rows that cannot be are dropped."""
    rows = foreign(spark, sf_dir).withColumn("m", X.parse(F.col("raw"))).where(X.usable(F.col("m")))
    return rows.select("conv_id", X.render(X.prepare(F.col("m")), X.declared(F.col("m"))).alias("text")).where("text is not null")
