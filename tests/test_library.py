"""Sources, sinks, messages, splits and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import messages as M
from corpusmill.functions import text as T
from corpusmill.operators import episodes, split
from corpusmill.operators.validate import require_valid
from corpusmill.sources import readers, writers
from corpusmill.streaming import ingest

TASK = {"task_id": "t", "repo_path": "r", "request": "q", "visible_test_command": ["a"], "hidden_test_command": ["b"]}


def test_placeholder_revisions_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="pinned"):
        readers.pinned(spark, str(tmp_path), "REPLACE_ME")


def test_task_manifest_is_strict(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(TASK) + "\n\n" + json.dumps(TASK | {"task_id": "u"}) + "\n")
    assert [r["task_id"] for r in readers.tasks(spark, str(good)).orderBy("task_id").collect()] == ["t", "u"]
    for name, task in (("extra", TASK | {"more": 1}), ("missing", {k: v for k, v in TASK.items() if k != "request"})):
        bad = tmp_path / f"{name}.jsonl"
        bad.write_text(json.dumps(task))
        with pytest.raises(Exception, match="task fields differ"):
            readers.tasks(spark, str(bad)).collect()


def test_search_skips_binaries_and_version_control(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("one\nneedle here\n")
    (tmp_path / "src/b.bin").write_bytes(b"needle\0")
    (tmp_path / ".git/c").write_text("needle")
    files = readers.file_tree(spark, str(tmp_path))
    assert [r["hit"] for r in readers.text_search(files, "needle").collect()] == ["src/a.py:2:needle here"]
    assert [r["hit"] for r in readers.text_search(files, "needle", most_bytes=3).collect()] == ["[search truncated after 0 MB]"]
    assert readers.text_search(files, "[").first()["hit"].startswith("invalid regular expression: ")
    (tmp_path / "src/c.txt").write_text("a\x0bneedle 1\u2028needle 2\r\n")
    hits = [r["hit"] for r in readers.text_search(readers.file_tree(spark, str(tmp_path)), "needle", most_hits=2).collect()]
    assert hits == ["src/a.py:2:needle here", "src/c.txt:2:needle 1", "[search truncated after 2 matches]"]


def test_tool_answers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three")
    files = readers.file_tree(spark, str(tmp_path))
    say = lambda name, **arguments: readers.answer_tool(files, name, arguments).first()["text"]
    assert say("list_files", path=".") == "b.txt\nsrc/a.py" and say("list_files", path="src") == "src/a.py" and say("list_files", path="none") == "[no files]"
    assert say("read_file", path="src/a.py") == "one\ntwo\n"
    assert say("search", query="t.o") == "src/a.py:2:two" and say("search", query="zzz") == "[no matches]" and say("search", query="(").startswith("invalid regular expression")
    assert say("shell", command="ls") == "shell is disabled" and say("bash") == "unknown tool: bash"
    assert say("read_file", path="../x") == "path leaves the repository"


def test_rows_need_their_declared_fields(spark):
    assert readers.from_rows(spark, [{"a": 1, "b": None}], "a long, b string").first().asDict() == {"a": 1, "b": None}
    for rows in ([{"a": 1}], [{"a": 1, "b": "x", "c": 2}], [{"a": "text", "b": "x"}]):
        with pytest.raises(Exception):  # noqa: B017
            readers.from_rows(spark, rows, "a long, b string").collect()


def test_audit_reports_errors_as_rows(spark, tmp_path):
    spark.range(3).withColumn("messages", F.array(F.lit("a"))).write.parquet(str(tmp_path / "ok"))
    found = readers.audit(spark, {"ok": str(tmp_path / "ok"), "gone": str(tmp_path / "gone")})
    assert found[0] == {"dataset": "ok", "rows": 3, "columns": ["id", "messages"], "with_messages": 3, "planning_direct_survival": 0, "error": None}
    assert found[1]["error"].startswith("AnalysisException: ")


def test_publishing_needs_both_splits_and_real_data(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "validation")], "id int, split string")
    with pytest.raises(ValueError, match="demonstration"):
        writers.publish_splits(df, str(tmp_path / "x"), demo=True)
    with pytest.raises(ValueError, match="validation"):
        writers.publish_splits(df.where("id = 1"), str(tmp_path / "x"))
    writers.publish_splits(df, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).where("split = 'train'").count() == 1


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    assert spark.read.json(writers.json_lines(df, str(tmp_path))).count() == 3
    writers.manifest(df.where("id = 1"), str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"id": 1, "text": "a"}
    assert writers.corpus_text(df, str(tmp_path / "c"), "id", 2) == {"documents": 2, "chars": 2, "words": 2}
    assert spark.read.text(str(tmp_path / "c"), wholetext=True).first()[0].rstrip("\0") == "a\n<|calibration_document|>\nb"
    for kind, demo, revision in (("dpo", True, "r1"), ("grpo", False, "REPLACE_ME"), ("grpo", False, None)):
        with pytest.raises(ValueError, match=kind):
            writers.refuse_demo(kind, demo, revision)
    writers.refuse_demo("dpo", False, "r1")


def test_fingerprint_survives_a_parquet_round_trip(spark, tmp_path):
    want = M.canonical(M.tools())
    rows = spark.createDataFrame([(want,)], "j string").select(F.from_json("j", M.TOOLS).alias("tools"))
    rows.write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).select(M.fingerprint(F.col("tools"))).first()[0] == want
    changed = M.tools()
    changed[0]["function"]["description"] = "else"
    assert M.canonical(changed) != want
    assert M.canonical({"a": None, "b": {}, "c": [None, 1]}) == '{"b":{},"c":[null,1]}'


def test_rendered_tools(spark):
    want = M.canonical(M.tools())
    lines = "\n".join(json.dumps(t) for t in M.tools())
    rows = spark.createDataFrame([(f"x <tools>\n{lines}\n</tools> y",), ("none",)], "p string")
    assert rows.where("p like 'x%'").select(M.rendered_tools(F.col("p"))).first()[0] == want
    for wrong in ("none", "<tools>\n{\"a\": 1\n</tools>", "</tools> <tools>"):
        with pytest.raises(Exception, match="tools block"):
            spark.createDataFrame([(wrong,)], "p string").select(M.rendered_tools(F.col("p"))).collect()


@pytest.mark.parametrize(("roles", "expected"), [("dsu", ["system", "user"]), ("d", ["system"]), ("uds", ["user", "developer", "system"]), ("u", ["user"])])
def test_folding(spark, roles, expected):
    names = {"d": "developer", "s": "system", "u": "user"}
    rows = spark.createDataFrame([([(names[r], r) for r in roles],)], "m array<struct<role:string,content:string>>")
    folded = rows.select(M.fold_system(F.col("m"))).first()[0]
    assert [m["role"] for m in folded] == expected
    if roles == "dsu":
        assert folded[0]["content"] == "d\n\ns"


def test_render_and_parse_round_trip(spark):
    patch = " first\n-old\n+new"
    raw = f"<think>why</think><tool_call>\n<function=apply_patch>\n<parameter=patch>\n{patch}\n</parameter>\n</function>\n</tool_call>"
    rows = spark.createDataFrame([(raw,)], "raw string")
    call = rows.select(M.parse_tool_calls(F.col("raw"))).first()[0][0]
    assert call["name"] == "apply_patch" and call["arguments"] == {"patch": patch}
    assert rows.select(T.patch_newline(F.lit(patch + "\r\n\n"))).first()[0] == patch + "\n"


def test_repeated_parameters_keep_the_last(spark):
    raw = "<tool_call><function=f><parameter=a>1</parameter><parameter=a>2</parameter></function></tool_call>"
    assert spark.createDataFrame([(raw,)], "r string").select(M.parse_tool_calls(F.col("r"))).first()[0][0]["arguments"] == {"a": "2"}


@pytest.mark.parametrize(("n", "k"), [(2, 1), (5, 1), (15, 2), (25, 2), (35, 4)])
def test_split_sizes(spark, n, k):
    rows = spark.createDataFrame([(f"f{i % n}", i) for i in range(3 * n)], "family string, id int")
    sides = {}
    for r in split.family_split(rows, "family").collect():
        sides.setdefault(r["split"], set()).add(r["family"])
    assert len(sides["validation"]) == k and not sides["validation"] & sides["train"]


def test_rows_without_a_family_stay(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "family string, id int")
    out = {r["id"]: r["split"] for r in split.family_split(rows, "family").collect()}
    assert len(out) == 4 and out[3] == out[4] and set(out.values()) == {"train", "validation"}


def test_the_hash_cut_is_the_kth(spark):
    hashes = sorted(f"{k * 7919 % 65536:04x}" for k in range(300))
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    assert [split.smallest_hash_cut(df, k, digits=1) for k in (1, 17, 300)] == [hashes[k - 1] for k in (1, 17, 300)]


def test_invalid_rows_fail_the_job(spark):
    rows = spark.createDataFrame([(k, [("no_messages", -1, "")] if k % 2 else []) for k in range(60)], "id int, e array<struct<code:string,idx:int,detail:string>>")
    with pytest.raises(ValueError, match="30 invalid rows, the first 20:\n1: no_messages@-1\n3: "):
        require_valid(rows, "e", "id")
    assert require_valid(rows.where("id % 2 = 0"), "e", "id").count() == 30


def message(role, content=None, thought=None, calls=None):
    return (role, content, thought, None, None, [(None, "function", c) for c in calls] if calls else None)


def test_a_whole_trajectory_is_rendered_and_read_back(spark):
    talk = [message("developer", "d"), message("system", "s"), message("user", "fix"), message("assistant", "on it", "why", [("apply_patch", {"patch": " a\n-b\n+c"}), ("run_tests", {"profile": "unit"})]), message("tool", "ok"), message("assistant", "done")]
    rows = spark.createDataFrame([(talk, [json.dumps(t) for t in M.tools()])], f"m array<{M.MESSAGE}>, t array<string>")
    folded = rows.select(M.fold_system(F.col("m"), M.OTHERS)).first()[0]
    assert (folded[0]["content"], len(folded), folded[2]["reasoning_content"]) == ("d\n\ns", 5, "why")
    text = rows.select(M.render_chat(F.col("m"), F.col("t"))).first()[0]
    assert text.count("<|im_start|>") == 5 and "<think>\nwhy\n</think>\n\non it\n<tool_call>" in text and "<tool_response>\nok\n</tool_response>" in text
    back = spark.createDataFrame([(text,)], "x string")
    assert back.select(M.rendered_tools(F.col("x"))).first()[0] == M.canonical(M.tools())
    calls = back.select(M.parse_tool_calls(F.substring_index("x", "<|im_start|>assistant", -2))).first()[0]
    assert [(c["name"], c["arguments"]) for c in calls] == [("apply_patch", {"patch": " a\n-b\n+c"}), ("run_tests", {"profile": "unit"})]


def test_preferences_that_are_none_fail(spark):
    def row(infra="ok", chosen=1.0, rejected=0.0):
        return spark.createDataFrame([([message("user", "q")], message("assistant", "a", "t"), message("assistant", "b"), chosen, rejected, infra)], f"p array<{M.MESSAGE}>, c {M.MESSAGE}, r {M.MESSAGE}, x double, y double, i string").select(M.preference(*map(F.col, "pcrxyi"))).first()[0]

    assert row()["chosen"] == "t\n</think>\n\na<|im_end|>\n" and row()["prompt"].endswith("<|im_start|>assistant\n<think>\n")
    for change, said in (({"infra": "failed"}, "infrastructure"), ({"chosen": 0.0}, "larger"), ({"infra": None}, "infrastructure")):
        with pytest.raises(Exception, match=said):
            row(**change)
    with pytest.raises(Exception, match="drifts"):
        spark.createDataFrame([("ab", "b")], "f string, p string").select(M.after_prefix(F.col("f"), F.col("p"))).collect()


def test_one_family_cannot_be_split(spark):
    with pytest.raises(ValueError, match="two families"):
        split.family_split(spark.createDataFrame([("a",)], "family string"), "family")


@pytest.mark.parametrize(
    ("turns", "end", "calls"),
    [([(1, 10.0), (0, 1.0)], "assistant_complete", 1), ([(6, 1.0), (5, 1.0)], "tool_budget", 6), ([(1, 500.0), (1, 1.0)], "timeout", 1), ([(1, 1.0)], "tool_budget", 1)],
)
def test_episodes(spark, turns, end, calls):
    df = spark.createDataFrame([("e", i, c, s) for i, (c, s) in enumerate(turns)], "ep string, i int, c int, s double")
    r = episodes.account(df, ["ep"], "i", F.col("c"), F.col("s")).first()
    assert (r["termination"], r["tool_calls"]) == (end, calls)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 5, i % 60), i, "click", 1.0, "{}") for i in range(40)]
    df = spark.createDataFrame(rows, ingest.EVENT)
    source, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    for part in (df.where("event_id < 25"), df.where("event_id >= 25")):
        part.write.mode("append").json(source)
        ingest.append(ingest.traces(spark, source), store, mark).awaitTermination()
    assert spark.read.parquet(store).count() == 40
    q = ingest.by_window(ingest.traces(spark, source)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, ingest.by_window(df).collect()))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
