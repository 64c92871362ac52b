"""Foreign tool-call rows (one JSON string a row) into messages and tools.

Arguments and parameters stay JSON text, so any shape of them survives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "struct<id:string,tool_call_id:string,type:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
TOOL = "struct<type:string,name:string,description:string,parameters:string,function:struct<name:string,description:string,parameters:string>>"
RAW = f"array<struct<role:string,content:string,think:string,think_fast:string,think_faster:string,name:string,tool_call_id:string,tool_calls:array<{CALL}>,tools:array<{TOOL}>>>"
#: Thought fields in order of preference, and the empty schema.
THOUGHTS = ["think", "think_fast", "think_faster"]
NO_PARAMETERS = '{"type":"object","properties":{}}'


def parse(raw: Column) -> Column:
    """The messages of a row, null if the JSON is none (SRC-08)."""
    return F.from_json(raw, RAW)


def _thought(m: Column) -> Column:
    return F.coalesce(*[F.when(m[k] != "", m[k]) for k in THOUGHTS])


def usable(messages: Column) -> Column:
    """Every assistant message has a thought, and there is one (FLT-07)."""
    spoken = F.filter(messages, lambda m: m["role"] == "assistant")
    return (F.size(spoken) > 0) & F.forall(spoken, lambda m: _thought(m).isNotNull())


def _arguments(text: Column) -> Column:
    """Arguments as JSON: objects as they are, strings that hold JSON as what
    they hold, other strings quoted."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(text.alias("v")))) - 6))


def calls(message: Column) -> Column:
    """Calls as (id, type, name, arguments); nested ones keep their function
    (FN-16)."""
    return F.transform(
        F.filter(message["tool_calls"], lambda c: c.isNotNull()),
        lambda c: F.struct(
            F.coalesce(c["id"], c["tool_call_id"]).alias("id"),
            F.coalesce(c["type"], F.lit("function")).alias("type"),
            F.coalesce(c["function"]["name"], c["name"], F.lit("")).alias("name"),
            _arguments(F.coalesce(c["function"]["arguments"], c["arguments"], F.lit("{}"))).alias("arguments"),
        ),
    )


def prepare(messages: Column, open_tag: str = "<think>", close_tag: str = "</think>") -> Column:
    """Messages with thoughts merged into contents, calls normalised, names of
    tool answers filled in (the last call with an id wins) and an empty system
    head dropped (FN-16, FN-18, FN-19, JON-02)."""
    known = F.filter(F.flatten(F.transform(messages, lambda m: F.coalesce(calls(m), F.array().cast("array<struct<id:string,type:string,name:string,arguments:string>>")))), lambda c: (c["id"] != "") & (c["name"] != ""))

    def name(m: Column) -> Column:
        own = F.filter(known, lambda c: c["id"] == m["tool_call_id"])
        return F.when(m["role"] != "tool", m["name"]).otherwise(F.coalesce(F.when(m["name"] != "", m["name"]), F.when(F.size(own) > 0, F.element_at(own, -1)["name"]), F.lit("unknown_tool")))

    def content(m: Column) -> Column:
        block = F.concat(F.lit(open_tag), _thought(m), F.lit(close_tag))
        merged = F.when(F.coalesce(m["content"], F.lit("")) != "", F.concat(block, F.lit("\n"), m["content"])).otherwise(block)
        return F.when((m["role"] == "assistant") & _thought(m).isNotNull(), merged).otherwise(m["content"])

    made = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), content(m).alias("content"), name(m).alias("name"), m["tool_call_id"].alias("tool_call_id"), calls(m).alias("tool_calls")))
    empty_head = (made[0]["role"] == "system") & made[0]["content"].isNull()
    return F.when(empty_head, F.slice(made, F.lit(2), F.size(made))).otherwise(made)


def declared(messages: Column) -> Column:
    """Tools of the first message as (type, name, description, parameters),
    with an empty schema where none is given (FN-17, FN-18)."""
    return F.transform(
        messages[0]["tools"],
        lambda t: F.struct(
            F.coalesce(t["type"], F.lit("function")).alias("type"),
            F.coalesce(t["function"]["name"], t["name"], F.lit("")).alias("name"),
            F.coalesce(t["function"]["description"], t["description"], F.lit("")).alias("description"),
            F.coalesce(t["function"]["parameters"], t["parameters"], F.lit(NO_PARAMETERS)).alias("parameters"),
        ),
    )


def without_start(text: Column, mark: str = "<bos>") -> Column:
    """Without a leading start mark (FN-15)."""
    return F.when(text.startswith(mark), text.substr(F.lit(len(mark) + 1), F.char_length(text))).otherwise(text)


def around(text: Column, sentinel: str, start: str) -> tuple[Column, Column]:
    """What a template puts before and after a sentinel; before, only from the
    last start marker on (FN-24)."""
    before, after = F.substring_index(text, sentinel, 1), F.substring_index(text, sentinel, -1)
    return F.when(before.contains(start), F.concat(F.lit(start), F.substring_index(before, start, -1))).otherwise(before), after


def render(prepared: Column, tools: Column) -> Column:
    """Prepared messages as text: the declared tools as JSON lines in the
    system turn, calls as JSON in their tags.  A row of which any part is
    missing gives null, which the caller drops (CMP-05)."""
    line = lambda t: F.concat(F.lit('{"name":"'), t["name"], F.lit('","parameters":'), t["parameters"], F.lit("}"))
    block = F.when(F.size(tools) > 0, F.concat(F.lit("<tools>\n"), F.array_join(F.transform(tools, line), "\n"), F.lit("\n</tools>")))
    called = lambda c: F.concat(F.lit('<tool_call>\n{"name":"'), c["name"], F.lit('","arguments":'), c["arguments"], F.lit("}\n</tool_call>"))

    def turn(m: Column) -> Column:
        calls_ = F.array_join(F.transform(m["tool_calls"], called), "\n")
        text = F.concat_ws("\n", F.when(m["content"] != "", m["content"]), F.when(F.size(m["tool_calls"]) > 0, calls_))
        return F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), text, F.lit("<|im_end|>\n"))

    own = F.get(prepared, F.lit(0))
    has = own["role"] == "system"
    system = F.concat_ws("\n\n", block, F.when(has, F.nullif(own["content"], F.lit(""))))
    head = F.when(system != "", F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))).otherwise("")
    rest = F.when(has, F.slice(prepared, F.lit(2), F.greatest(F.size(prepared) - 1, F.lit(0)))).otherwise(prepared)
    turns = F.transform(rest, turn)
    return F.when(~F.exists(turns, lambda t: t.isNull()), F.concat(head, F.array_join(turns, "")))
