"""Message lists: folding, rendering, parsing and tool declarations."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

MESSAGE = "struct<role:string,content:string,reasoning_content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:map<string,string>>>>>"

#: The six tools' name, description and only argument.
TOOL_TABLE = [
    ("list_files", "List files below a repository-relative directory.", "path"),
    ("read_file", "Read a UTF-8 repository file with bounded output.", "path"),
    ("search", "Search repository text using a regular expression.", "query"),
    ("apply_patch", "Apply a unified diff to files inside the repository.", "patch"),
    ("run_tests", "Run an allow-listed repository test profile.", "profile"),
    ("shell", "Run a restricted allow-listed command. It is disabled in the pilot.", "command"),
]
#: Version tag of this tool surface; pass the tag your rows carry.
SCHEMA_VERSION = "six-tools-v1"
PROFILES = ["unit"]


def tools() -> list[dict]:
    """The declared tool surface as JSON objects."""
    made = []
    for name, description, argument in TOOL_TABLE:
        kind = {"type": "string"} | ({"enum": PROFILES} if argument == "profile" else {})
        made.append({"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": {argument: kind}, "required": [argument], "additionalProperties": False}}})
    return made


def without_nulls(value: object) -> object:
    """Objects lose null members at every depth; lists keep null elements."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    """The fingerprint of a declaration: sorted keys, no spaces, raw Unicode."""
    return json.dumps(without_nulls(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Tool declarations with fields in alphabetical order, so that to_json is the
#: canonical fingerprint (FN-02).
TOOLS = "array<struct<function:struct<description:string,name:string,parameters:struct<additionalProperties:boolean,properties:struct<command:struct<type:string>,patch:struct<type:string>,path:struct<type:string>,profile:struct<enum:array<string>,type:string>,query:struct<type:string>>,required:array<string>,type:string>>,type:string>>"


def fingerprint(declared: Column) -> Column:
    return F.to_json(declared)


def tools_block(prompt: Column) -> Column:
    """The text between the first opening tag of a tools block and the closing
    tag after it; null without one."""
    after = prompt.substr(F.instr(prompt, "<tools>") + 7, F.char_length(prompt))
    return F.when(prompt.contains("<tools>") & after.contains("</tools>"), F.substring_index(after, "</tools>", 1))


def rendered_tools(prompt: Column) -> Column:
    """Canonical declarations inside a rendered prompt's tools block; a prompt
    without a block, and a line that is no JSON, fail the job (FN-03)."""
    lines = F.filter(T.lines(tools_block(prompt)), lambda x: T.strip(x) != "")
    wrong = F.exists(lines, lambda x: F.try_parse_json(x).isNull())
    read = F.to_json(F.from_json(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), TOOLS))
    return F.when(tools_block(prompt).isNull(), F.raise_error(F.lit("the prompt has no tools block"))).when(wrong, F.raise_error(F.lit("a line of the tools block is no JSON"))).otherwise(read)


#: Fields of a message beside role and content, with their types.
CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:map<string,string>>>>"
OTHERS = {"reasoning_content": "string", "name": "string", "tool_call_id": "string", "tool_calls": CALLS}


def fold_system(messages: Column, others: dict[str, str] | None = None) -> Column:
    """The leading system and developer messages as one system message, the
    contents joined by a blank line; later ones stay, and every other message
    stays as it is, with all its fields (FN-04).

    others: the message's further fields and their types, which the folded
    message has as nulls.
    """
    opening = lambda m: m["role"].isin("system", "developer")
    rest_from = F.filter(F.transform(messages, lambda m, i: F.struct(i.alias("i"), opening(m).alias("opening"))), lambda x: ~x["opening"])
    n = F.when(F.size(rest_from) > 0, F.get(rest_from, F.lit(0))["i"]).otherwise(F.size(messages))

    def folded(n: Column) -> Column:
        head = F.slice(messages, F.lit(1), n)
        joined = F.array_join(F.transform(head, lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")

        def one(m: Column) -> Column:
            m = m.withField("role", F.lit("system")).withField("content", joined)
            for name, kind in (others or {}).items():
                m = m.withField(name, F.lit(None).cast(kind))
            return m

        return F.concat(F.transform(F.slice(head, F.lit(1), F.lit(1)), one), F.slice(messages, n + 1, F.greatest(F.size(messages) - n, F.lit(0))))

    return T.bound(n, folded)


def render_chatml(messages: Column) -> Column:
    """Turn markers around role and content of each message of a folded list:
    what plain conversations need."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(fold_system(messages), turn), "")


def rendered_call(call: Column) -> Column:
    """A tool call in the native format that `parse_tool_calls` reads."""
    parameter = lambda e: F.concat(F.lit("<parameter="), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("")), F.lit("\n</parameter>\n"))
    body = F.array_join(F.transform(F.map_entries(F.coalesce(call["function"]["arguments"], F.create_map().cast("map<string,string>"))), parameter), "")
    return F.concat(F.lit("<tool_call>\n<function="), call["function"]["name"], F.lit(">\n"), body, F.lit("</function>\n</tool_call>"))


def render_chat(messages: Column, tools: Column | None = None, generation_prompt: bool = False, options: Column | None = None) -> Column:
    """A whole trajectory as text (FN-05): the declared tools (an array of JSON
    lines) inside the system turn, thoughts of every assistant turn, calls in
    the native format, and answers of tools in turns of their own.

    messages: array of MESSAGE.  options: a map that travels with the row
    (UDF-06): enable_thinking `false` closes the thought at once, and
    reasoning_effort is stated in the system turn.
    """
    options = F.create_map().cast("map<string,string>") if options is None else options
    think = F.coalesce(options["enable_thinking"], F.lit("true")) != "false"
    block = F.lit(None).cast("string") if tools is None else F.when(F.size(tools) > 0, F.concat(F.lit("<tools>\n"), F.array_join(tools, "\n"), F.lit("\n</tools>")))
    effort = F.when(options["reasoning_effort"].isNotNull(), F.concat(F.lit("Reasoning effort: "), options["reasoning_effort"]))

    def turn(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        thought = F.concat(F.lit("<think>\n"), F.coalesce(m["reasoning_content"], F.lit("")), F.lit("\n</think>\n\n"))
        made = F.transform(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), rendered_call)
        spoken = F.concat(thought, content, F.when((content != "") & (F.size(made) > 0), "\n").otherwise(""), F.array_join(made, "\n"))
        role = F.when(m["role"] == "tool", "user").otherwise(m["role"])
        text = F.when(m["role"] == "assistant", spoken).when(m["role"] == "tool", F.concat(F.lit("<tool_response>\n"), content, F.lit("\n</tool_response>"))).otherwise(content)
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))

    def rendered(folded: Column) -> Column:
        has = (F.size(folded) > 0) & (F.get(folded, F.lit(0))["role"] == "system")
        own = F.when(has, F.nullif(F.coalesce(F.get(folded, F.lit(0))["content"], F.lit("")), F.lit("")))
        system = F.concat_ws("\n\n", block, effort, own)
        head = F.when(has | (system != ""), F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))).otherwise("")
        turns = F.transform(F.when(has, F.slice(folded, F.lit(2), F.greatest(F.size(folded) - 1, F.lit(0)))).otherwise(folded), turn)
        text = F.concat(head, F.array_join(turns, ""))
        return F.concat(text, F.lit("<|im_start|>assistant\n<think>\n"), F.when(think, "").otherwise("\n</think>\n\n")) if generation_prompt else text

    return T.bound(fold_system(messages, OTHERS), rendered)


def after_prefix(full: Column, prompt: Column) -> Column:
    """What follows a prompt in a full text (FN-10); a text that does not
    begin with its prompt fails the job."""
    return F.when(full.startswith(prompt), full.substr(F.char_length(prompt) + 1, F.char_length(full))).otherwise(F.raise_error(F.lit("the template's prefix drifts: a completion cannot be told from its prompt")))


def preference(prompt: Column, chosen: Column, rejected: Column, chosen_reward: Column, rejected_reward: Column, infra: Column, tools: Column | None = None) -> Column:
    """(prompt, chosen, rejected) texts of a preference row (CMP-04).  Failed
    infrastructure comes first, then rewards that do not prefer, then a prefix
    that drifts; each fails the job (GATE-05)."""
    before = render_chat(prompt, tools, generation_prompt=True)
    completion = lambda m: after_prefix(render_chat(F.concat(prompt, F.array(m)), tools), before)
    ok = F.struct(before.alias("prompt"), completion(chosen).alias("chosen"), completion(rejected).alias("rejected"))
    return F.when(~infra.eqNullSafe(F.lit("ok")), F.raise_error(F.lit("an infrastructure failure is no preference"))).when(~F.coalesce(chosen_reward > rejected_reward, F.lit(False)), F.raise_error(F.lit("the chosen reward must be the larger one"))).otherwise(ok)


def supervision(messages: Column, answer: Column, observation: Column) -> Column:
    """The audit of what is trained on (CMP-18, AGG-11): the supervised text,
    and whether any of it is trained, nothing before the first answer is, the
    expected answer is in it and the tools' observation is not."""
    def audit(spans: Column) -> Column:
        on = F.filter(spans, lambda s: s["trainable"])
        joined = F.array_join(F.transform(on, lambda s: s["text"]), "\n")
        first = F.array_position(F.transform(spans, lambda s: s["trainable"]), F.lit(True))
        before = F.slice(spans, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0)))
        return F.struct(joined.alias("text"), (F.size(on) > 0).alias("any_trained"), (~F.exists(before, lambda s: s["trainable"])).alias("nothing_before"), joined.contains(answer).alias("answer"), (~joined.contains(observation)).alias("no_observation"))

    return T.bound(trainable(messages), audit)


#: Patterns of native tool calls.
CALL = r"(?s)<tool_call>\s*<function=([^>\n]+)>\s*(.*?)</function>\s*</tool_call>"
PARAMETER = r"(?s)<parameter=([^>\n]+)>(?:\r?\n)?(.*?)\s*</parameter>"


def last_of_each(pairs: Column) -> Column:
    """A map of (k, v) pairs in which the last value of a key wins, whatever
    the session's policy for repeated keys."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def parse_tool_calls(raw: Column) -> Column:
    """Calls of a completion: array of (name, arguments); a parameter given
    twice keeps its last value, a patch its inner white space (FN-07)."""
    _, content = T.split_reasoning(raw)
    names = F.regexp_extract_all(content, F.lit(CALL), F.lit(1))
    bodies = F.regexp_extract_all(content, F.lit(CALL), F.lit(2))

    def arguments(body: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(1)), T.strip)
        values = F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), F.when(k == "patch", F.regexp_replace(v, r"[\r\n]+\z", "")).otherwise(T.strip(v)).alias("v")))
        return T.bound(pairs, lambda p: last_of_each(p))

    return F.zip_with(names, bodies, lambda n, b: F.struct(T.strip(n).alias("name"), arguments(b).alias("arguments")))


def malformed_call(raw: Column) -> Column:
    """A call was opened but none parses: the turn is no final answer."""
    return raw.contains("<tool_call>") & (F.size(parse_tool_calls(raw)) == 0)


def backfill_names(messages: Column) -> Column:
    """Names of tool messages from the calls they answer; the last call with
    an id wins, unknown ids are unknown_tool (JON-02)."""
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:map<string,string>>>>"))))
    known = F.filter(calls, lambda c: c["id"].isNotNull())

    def name(m: Column) -> Column:
        own = F.filter(known, lambda c: c["id"] == m["tool_call_id"])
        return F.when(m["role"] != "tool", m["name"]).otherwise(F.coalesce(m["name"], F.when(F.size(own) > 0, F.element_at(own, -1)["function"]["name"]), F.lit("unknown_tool")))

    return F.transform(messages, lambda m: m.withField("name", name(m)))


def trainable(messages: Column) -> Column:
    """Spans with a mask: only assistant text is trained on (FN-27)."""
    return F.transform(messages, lambda m: F.struct(F.concat(m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit(""))).alias("text"), (m["role"] == "assistant").alias("trainable")))
