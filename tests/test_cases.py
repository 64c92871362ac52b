"""Typed-in cases of the rules, each with the answer that it must give."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import foreign as X
from corpusmill.functions import messages as M
from corpusmill.functions import text as T
from corpusmill.operators import rewards as R
from corpusmill.operators.validate import validate


def _call(name, **arguments):
    return {"type": "function", "function": {"name": name, "arguments": arguments}}


_USER, _ASK = {"role": "user", "content": "fix"}, {"role": "assistant", "content": "", "tool_calls": [_call("read_file", path="a")]}
_ANSWER, _DONE = {"role": "tool", "name": "read_file", "content": "x"}, {"role": "assistant", "content": "done"}
#: name, messages, changes of the row, codes that must come out in order.
TRAJECTORIES = [
    ("good", [_USER, _ASK, _ANSWER, _DONE], {}, ""),
    ("version", [_USER, _ASK, _ANSWER, _DONE], {"version": "v0"}, "schema_version:-1"),
    ("json", [_USER, _ASK, _ANSWER, _DONE], {"stored": "[]"}, "schema_json:-1"),
    ("tools", [_USER, _ASK, _ANSWER, _DONE], {"declared": None}, "tools_differ:-1"),
    ("empty", [], {"version": "v0"}, "no_messages:-1"),
    ("role", [{"role": "robot"}, _ASK, _ANSWER, _DONE], {}, "unexpected_role:0"),
    ("early", [_USER, _ASK, _DONE, _ANSWER], {}, "turn_before_response:2"),
    ("unknown", [_USER, {"role": "assistant", "tool_calls": [_call("bash", command="ls")]}, _DONE], {}, "unknown_tool:1,no_tool_call:-1"),
    ("mapping", [_USER, {"role": "assistant", "tool_calls": [{"function": {"name": "read_file"}}]}, _DONE], {}, "arguments_not_mapping:1,no_tool_call:-1"),
    ("missing", [_USER, {"role": "assistant", "tool_calls": [_call("read_file")]}, _ANSWER, _DONE], {}, "missing_argument:1"),
    ("extra", [_USER, {"role": "assistant", "tool_calls": [_call("read_file", path="a", mode="r")]}, _ANSWER, _DONE], {}, "unknown_argument:1"),
    ("orphan", [_USER, _ANSWER, _ASK, _ANSWER], {}, "response_without_call:1"),
    ("name", [_USER, _ASK, {"role": "tool", "name": "search"}, _DONE], {}, "wrong_response_name:2"),
    ("middle", [_USER, _ASK, _USER, _ANSWER], {}, "unresolved_responses:2"),
    ("end", [_USER, _ASK], {}, "ends_unresolved:-1"),
    ("none", [_USER, _DONE], {}, "no_tool_call:-1"),
    ("unverified", [_USER, _ASK, _ANSWER, _DONE], {"verified": False}, "not_verified:-1"),
    ("no flag", [_USER, _ASK, _ANSWER, _DONE], {"verified": None}, "not_verified:-1"),
]


def test_every_rule_of_the_validator(spark):
    want = M.canonical(M.tools())
    rows = [(name, *(change.get(k, v) for k, v in (("version", M.SCHEMA_VERSION), ("stored", want), ("declared", want))), json.dumps(talk), change.get("verified", True)) for name, talk, change, _ in TRAJECTORIES]
    df = spark.createDataFrame(rows, "id string, version string, stored string, declared string, j string, verified boolean")
    errors = validate(F.col("version"), F.col("stored"), M.fingerprint(F.from_json("declared", M.TOOLS)), F.from_json("j", f"array<{M.MESSAGE}>"), F.col("verified"))
    found = {r[0]: ",".join(f"{e['code']}:{e['idx']}" for e in r[1]) for r in df.select("id", errors).collect()}
    assert found == {name: codes for name, _, _, codes in TRAJECTORIES}


def of(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_toy_rewards(spark):
    rows = [(False, False, False, 0, "d", "d", False), (True, True, True, 0, "d", "d", False), (True, True, True, 0, "x", "d", False), (True, False, False, 2, "d", "d", False), (True, True, False, 1, "d", "d", False), (True, True, True, 0, "d", "d", True)]
    names = "visible ran hidden tool_errors digest expected errored".split()
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, ("boolean", "boolean", "boolean", "int", "string", "string", "boolean"), strict=True))
    assert [x for (x,) in of(spark, schema, rows, R.toy(*map(F.col, names)).cast("double"))] == pytest.approx([0, 1, 0, 0, 0.15, 0])


@pytest.mark.parametrize(("answer", "ok"), [("42", True), ("-3.5", True), ("1,200", True), (" 7 ", True), ("\\frac{1}{2}", False), ("1e5", False), ("", False), ("12 apples", False), ("+4", False), ("0.0", True)])
def test_bare_numbers(spark, answer, ok):
    assert of(spark, "a string", [(answer,)], T.bare_number(F.col("a"))) == [(ok,)]


COMPLETIONS = [
    ("<think>The index may be stale.</think>\n\n<tool_call>\n<function=read_file>\n<parameter=path>\nlib/index.rs\n</parameter>\n</function>\n</tool_call>", "The index may be stale.", "read_file", "path=lib/index.rs", False),
    ("</think><tool_call>\n<function=apply_patch>\n<parameter=patch>\n first\n-old\n+new\n</parameter>\n</function>\n</tool_call><tool_call><function=run_tests><parameter=profile> unit </parameter></function></tool_call>", "", "apply_patch;run_tests", "patch= first\n-old\n+new;profile=unit", False),
    ("plain answer without a tag  ", "", "", "", False),
    ("<think>a</think>b</think>c", "a", "", "", False),
    ("<think>x</think><tool_call><function read_file></function></tool_call>", "x", "", "", True),
    ("", "", "", "", False),
]


def test_completions_are_split_and_parsed(spark):
    calls = M.parse_tool_calls(F.col("raw"))
    rows = of(spark, "raw string", [(c[0],) for c in COMPLETIONS], T.split_reasoning(F.col("raw"))[0], calls, M.malformed_call(F.col("raw")))
    found = [(r, ";".join(c["name"] for c in cs), ";".join(f"{k}={v}" for c in cs for k, v in c["arguments"].items()), bad) for r, cs, bad in rows]
    assert found == [tuple(c[1:]) for c in COMPLETIONS]


def test_channels_and_their_rewards(spark):
    rows = [(" to=self<|message|>9 crates of 6<|eom|><|start|>assistant to=user<|message|>54<|eot|>", "54"), (" to=self 9 crates to=user 54", "54"), ("no word of it", "5"), ("to=user to=user<|message|>1,200 apples<|eot|>x", "1200"), (None, "1")]
    c = F.coalesce("c", F.lit(""))
    found = of(spark, "c string, g string", rows, *T.split_channels(F.col("c")), R.channel_format(c).cast("double"), R.number_format(c).cast("double"), R.number_correct(c, F.col("g")).cast("double"))
    assert found == [("9 crates of 6", "54", 1.5, 1.0, 4.0), ("9 crates", "54", 1.5, 1.0, 4.0), ("no word of it", "", -0.5, -0.5, -0.5), ("to=user", "1,200 apples", 1.5, 0.25, 4.0), ("", "", -1.0, -0.5, -0.5)]


def test_spans_and_their_rewards(spark):
    rows = [("<REASONING>a</REASONING><SOLUTION>4\n2</SOLUTION>", "42"), ("<SOLUTION>1</SOLUTION><SOLUTION>2</SOLUTION>", "1"), ("addCriterion\n\n\nok", "ok"), ("", "x")]
    assert of(spark, "c string, a string", rows, R.span_format(F.col("c")).cast("double"), R.span_correct(F.col("c"), F.col("a")).cast("double")) == [(2, 2), (0, 0), (-2, 0), (0, 0)]


def test_paths_that_leave_their_root(spark):
    rows = [("src/a.py",), ("a/../b",), ("../x",), ("/etc/passwd",), ("a/../../b",), (".",)]
    assert [x for (x,) in of(spark, "p string", rows, T.inside_root(F.col("p")))] == [True, True, False, False, False, True]


FOREIGN = [
    (1, '[{"role":"system","tools":[{"name":"f","description":"d"}]},{"role":"user","content":"q"},{"role":"assistant","think":"t","content":"c","tool_calls":[{"tool_call_id":"a","name":"f","arguments":"{\\"x\\":1}"}]},{"role":"tool","tool_call_id":"a","content":"r"}]'),
    (2, '[{"role":"user","content":"q"},{"role":"assistant","content":"no thought"}]'),
    (3, '[{"role":"user","content":"q"}]'),
    (4, '[{"role":"system","content":"s"},{"role":"assistant","think_fast":"t","tool_calls":[{"id":"b","type":"function","function":{"name":"g","arguments":{"y":[2,{"z":null}]}}}]},{"role":"tool","content":"r"}]'),
    (5, "not json"),
]


def test_foreign_rows_are_prepared_and_rendered(spark):
    rows = spark.createDataFrame(FOREIGN, "id int, raw string").withColumn("m", X.parse(F.col("raw"))).where(X.usable(F.col("m")))
    found = {r[0]: r[1] for r in rows.select("id", X.render(X.prepare(F.col("m")), X.declared(F.col("m")))).where("id is not null").collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    head = '<|im_start|>system\n<tools>\n{"name":"f","parameters":{"type":"object","properties":{}}}\n</tools><|im_end|>\n'
    assert found == {
        1: head + turn("user", "q") + turn("assistant", '<think>t</think>\nc\n<tool_call>\n{"name":"f","arguments":{"x":1}}\n</tool_call>') + turn("tool", "r"),
        4: turn("system", "s") + turn("assistant", '<think>t</think>\n<tool_call>\n{"name":"g","arguments":{"y":[2,{"z":null}]}}\n</tool_call>') + turn("tool", "r"),
    }


def test_names_come_from_the_last_call_with_an_id(spark):
    raw = '[{"role":"assistant","tool_calls":[{"id":"a","function":{"name":"old"}},{"id":"a","function":{"name":"read_file"}},{"id":"b","function":{"name":"search"}}]},{"role":"tool","tool_call_id":"a"},{"role":"tool","tool_call_id":"b"},{"role":"tool","tool_call_id":"z"}]'
    ((m,),) = of(spark, "j string", [(raw,)], M.backfill_names(F.from_json("j", f"array<{M.MESSAGE}>")))
    assert [x["name"] for x in m] == [None, "read_file", "search", "unknown_tool"]


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ('{"b": 1, "a": {"d": null, "c": [null, {"y": null, "x": 1.5}]}, "z": null}', '{"a":{"c":[null,{"x":1.5}]},"b":1}'),
        ('{"a": null}', "{}"),
        ('["x", ":null", {"k": ":null,"}]', '["x",":null",{"k":":null,"}]'),
        (r'{"a": "q\"k\":null,}", "b\"": null, "c": true}', r'{"a":"q\"k\":null,}","c":true}'),
        ("null", "null"),
        ("[]", "[]"),
        ("not json", None),
        (None, None),
    ],
)
def test_canonical_json(spark, text, canonical):
    assert of(spark, "t string", [(text,)], T.canonical_json(F.col("t"))) == [(canonical,)]


@pytest.mark.parametrize("text", ["a b", "a\u00a0b", " a\u2003b\u0085c\u3000", "\x1c", "", "a\x0bb\tc", "a\u200bb", None])
def test_words_are_counted_at_any_white_space(spark, text):
    assert of(spark, "t string", [(text,)], T.word_count(F.col("t"))) == [(len((text or "").split()),)]
