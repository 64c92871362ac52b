"""Trajectory validation as a fold over messages: a state machine in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M

ERROR = "array<struct<code:string,idx:int,detail:string>>"
ROLES = ["system", "developer", "user", "assistant", "tool"]


def _error(code: str, idx: Column, detail: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), idx.cast("int").alias("idx"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def _some(condition: Column, error: Column) -> Column:
    return F.when(condition, F.array(error)).otherwise(F.array().cast(ERROR))


def message_errors(messages: Column, names: Column, arguments_ok: Column | None = None) -> Column:
    """Errors of the message rules V5 to V14, by message.

    names: map of tool name to its required argument names.  The state is the
    queue of calls that wait for an answer, whether any call was valid, and
    the errors so far.
    """
    state = F.struct(F.array().cast("array<string>").alias("pending"), F.lit(False).alias("saw"), F.array().cast(ERROR).alias("errors"))
    no_calls = F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:map<string,string>>>>")
    indexed = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m.alias("m")))

    def step(s: Column, x: Column) -> Column:
        m, i = x["m"], x["i"]
        pending, role = s["pending"], m["role"]
        waiting = F.array_join(pending, ",")
        strange = _some(role.isNull() | ~role.isin(*ROLES), _error("unexpected_role", i, F.coalesce(role, F.lit(""))))
        calls = F.coalesce(m["tool_calls"], no_calls)
        known = F.filter(calls, lambda c: F.coalesce(F.map_contains_key(names, F.coalesce(c["function"]["name"], F.lit(""))), F.lit(False)))
        valid = F.filter(known, lambda c: c["function"]["arguments"].isNotNull())

        def call_errors(c: Column) -> Column:
            name, given = c["function"]["name"], F.map_keys(c["function"]["arguments"])
            need = names[name]
            return (
                F.when(~F.coalesce(F.map_contains_key(names, F.coalesce(name, F.lit(""))), F.lit(False)), F.array(_error("unknown_tool", i, F.coalesce(name, F.lit("")))))
                .when(c["function"]["arguments"].isNull(), F.array(_error("arguments_not_mapping", i, name)))
                .otherwise(F.concat(_some(F.size(F.array_except(need, given)) > 0, _error("missing_argument", i, name)), _some(F.size(F.array_except(given, need)) > 0, _error("unknown_argument", i, name))))
            )

        spoken = F.concat(_some(F.size(pending) > 0, _error("turn_before_response", i, waiting)), F.flatten(F.transform(calls, call_errors)))
        head = F.when(F.size(pending) > 0, pending[0])
        answered = F.when(F.size(pending) == 0, F.array(_error("response_without_call", i))).otherwise(_some(~m["name"].eqNullSafe(head), _error("wrong_response_name", i, F.coalesce(m["name"], F.lit("")))))
        other = _some(F.size(pending) > 0, _error("unresolved_responses", i, waiting))
        return F.struct(
            F.when(role == "assistant", F.concat(pending, F.transform(valid, lambda c: c["function"]["name"]))).when((role == "tool") & (F.size(pending) > 0), F.slice(pending, F.lit(2), F.size(pending))).otherwise(pending).alias("pending"),
            (s["saw"] | ((role == "assistant") & (F.size(valid) > 0))).alias("saw"),
            F.concat(s["errors"], strange, F.when(role == "assistant", spoken).when(role == "tool", answered).otherwise(other)).alias("errors"),
        )

    def finish(s: Column) -> Column:
        end = F.lit(-1)
        return F.concat(s["errors"], _some(F.size(s["pending"]) > 0, _error("ends_unresolved", end, F.array_join(s["pending"], ","))), _some(~s["saw"], _error("no_tool_call", end)))

    return F.aggregate(indexed, state, step, finish)


def validate(version: Column, stored: Column, declared: Column, messages: Column, verified: Column, tag: str = M.SCHEMA_VERSION) -> Column:
    """All errors of a trajectory row in rule order (V1 to V14): code, message
    index (-1 for the row) and detail.  Without messages that is the only
    error, whatever else is wrong."""
    want = M.canonical(M.tools())
    names = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for name, _, arg in M.TOOL_TABLE for x in (name, [arg])])
    row = F.lit(-1)
    before = F.concat(
        _some(~version.eqNullSafe(F.lit(tag)), _error("schema_version", row)),
        _some(~stored.eqNullSafe(F.lit(want)), _error("schema_json", row)),
        _some(~F.coalesce(declared, F.lit("[]")).eqNullSafe(F.lit(want)), _error("tools_differ", row)),
    )
    after = _some(~F.coalesce(verified, F.lit(False)), _error("not_verified", row))
    empty = messages.isNull() | (F.size(messages) == 0)
    return F.when(empty, F.array(_error("no_messages", row))).otherwise(F.concat(before, message_errors(messages, names), after))


def require_valid(rows: DataFrame, errors: str, key: str, shown: int = 20) -> DataFrame:
    """The rows, if none has errors; else the job fails and shows the first
    ones by key (GATE-01)."""
    wrong = rows.where(F.size(errors) > 0)
    if first := wrong.select(key, errors).orderBy(key).limit(shown).collect():
        lines = "\n".join(f"{r[0]}: " + ", ".join(f"{e['code']}@{e['idx']}" for e in r[1]) for r in first)
        raise ValueError(f"{wrong.count()} invalid rows, the first {len(first)}:\n{lines}")
    return rows
