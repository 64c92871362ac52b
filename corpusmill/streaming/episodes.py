"""Episodes as a stateful stream: a log of turns that arrives in any number of
batches, states by groups of episodes, and results that are written once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

RESULT = "termination string, tool_calls long, wall_seconds double, turns long"
#: Of a group of episodes: their table as an Arrow stream, and its timer.
_STATE = "episodes binary, timer long"
_USED = ["seconds", "calls", "wall", "turns", "stopped", "due"]
_ENDS = ["", "timeout", "assistant_complete", "tool_budget"]
#: Groups that episodes are dealt to; each has one state and one timer.
GROUPS = 256
#: Keyed state with timers needs this state store.
SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accountant(names: list[str], max_calls: int, timeout: float, idle: float) -> StatefulProcessor:
    """The processor of a group of episodes; a class of its own in here, so it
    travels by value and the state workers need not find this package."""

    class Account(StatefulProcessor):
        """The rules of `operators.episodes.account`, turn by turn, for all
        episodes of a group at once.

        The state is a row an episode: four numbers, whether it has ended and
        when it is idle, so it does not grow with the turns.  An episode that
        ends is emitted at once, and later turns of it change nothing; one that
        does not is emitted by the group's timer when the watermark is past its
        idle time.  Then its row goes.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("episodes", _STATE)

        def _held(self) -> tuple[pd.DataFrame | None, int | None]:
            if not self.state.exists():
                return None, None
            held, timer = self.state.get()
            return pa.ipc.open_stream(bytes(held)).read_pandas(), timer

        def _hold(self, found: pd.DataFrame, timer: int | None) -> None:
            """Keep these rows and one timer, for the first that is idle; no
            rows, no state.  `timer`: the one that is set."""
            following = int(found["due"].min()) if len(found) else None
            if timer != following:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if following is not None:
                    self.handle.registerTimer(following)
            if following is None:
                self.state.clear()
                return
            rows, out = pa.Table.from_pandas(found, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema) as to:
                to.write_table(rows)
            self.state.update((out.getvalue().to_pybytes(), following))

        def _rows(self, found: pd.DataFrame, ended: np.ndarray) -> pd.DataFrame:
            out = found[[*names, "calls", "wall", "turns"]].set_axis([*names, "tool_calls", "wall_seconds", "turns"], axis=1)
            return out.assign(termination=np.array(_ENDS, object)[ended])[[*names, "termination", "tool_calls", "wall_seconds", "turns"]]

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held, timer = self._held()
            batch = pd.concat(list(rows), ignore_index=True)
            keys = batch[names] if held is None else pd.concat([held[names], batch[names]], ignore_index=True)
            code = keys.groupby(names, sort=False, dropna=False).ngroup().to_numpy()  # in the order of their first rows: those held, then new ones
            found = keys.loc[~keys.duplicated()].reset_index(drop=True)
            old, k = 0 if held is None else len(held), len(found)
            used = {c: np.zeros(k, kind) for c, kind in zip(_USED, (float, np.int64, float, np.int64, bool, np.int64), strict=True)}
            for c in _USED if old else []:
                used[c][:old] = held[c].to_numpy()
            code = code[old:]
            np.maximum.at(used["due"], code, batch["ms"].to_numpy() + int(idle * 1000))
            order = np.lexsort((batch["position"].to_numpy(), code))
            n, took, final = (batch[c].to_numpy()[order] for c in ("calls", "seconds", "final"))
            length = np.bincount(code, minlength=k)
            start, ended, step = np.cumsum(length) - length, np.zeros(k, np.int64), 0
            live = np.flatnonzero((length > 0) & ~used["stopped"])
            while live.size:  # the next turn of every episode that goes on
                at = start[live] + step
                late = ~(used["seconds"][live] <= timeout)
                done = ~late & final[at]
                over = ~late & ~done & (used["calls"][live] + n[at] > max_calls)
                on = ~(late | done | over)
                used["wall"][live] += np.where(late, 0.0, took[at])
                used["turns"][live] += done | on
                used["seconds"][live] += np.where(on, took[at], 0.0)
                used["calls"][live] += np.where(on, n[at], 0)
                ended[live] = late + 2 * done + 3 * over
                step += 1
                live = live[on & (length[live] > step)]
            used["stopped"] |= ended > 0
            found = found.assign(**used)
            self._hold(found, timer)
            if ended.any():
                yield self._rows(found.loc[ended > 0], ended[ended > 0])

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held, _ = self._held()
            if held is not None:
                idle_now = held["due"] <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
                self._hold(held.loc[~idle_now], None)  # the timer that has expired is gone
                open_ = held.loc[idle_now & ~held["stopped"]]
                if len(open_):
                    yield self._rows(open_, np.full(len(open_), 3))

        def close(self) -> None:
            return

    return Account()


def account_stream(turns: DataFrame, episode: list[str], position: str, at: str, calls: Column, seconds: Column, max_calls: int = 10, timeout: float = 480.0, idle: float = 86_400.0, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """How each episode of a stream of turns ends and what it used; the same
    rows as `operators.episodes.account` of the whole log, if an episode's
    turns arrive in the order of their positions from batch to batch and none
    later than `late` after a day's idleness.  Turns of no episode, with a null
    in its columns, are left out.

    Episodes are dealt to `groups` by hash, and a batch folds a group's turns
    at once: a state, a timer and a call of Python for each episode cost
    milliseconds each.  The number must stay as it is from restart to restart.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in episode])
    group = F.pmod(F.xxhash64(*episode), F.lit(groups)).alias("_group")
    used = [F.coalesce(calls.cast("long"), F.lit(0)).alias("calls"), F.coalesce(calls == 0, F.lit(False)).alias("final"), F.coalesce(seconds.cast("double"), F.lit(0.0)).alias("seconds")]
    rows = turns.where(known).withWatermark(at, late).select(group, *episode, F.col(position).cast("long").alias("position"), F.col(at).alias("at"), F.coalesce(F.unix_millis(at), F.lit(0)).alias("ms"), *used)
    key = rows.select(*episode).schema
    out = StructType(key.fields + StructType.fromDDL(RESULT).fields)
    ended = rows.groupBy("_group").transformWithStateInPandas(accountant(key.names, max_calls, timeout, idle), out, "Append", "EventTime")
    return ended.withColumn("wall_seconds", F.round("wall_seconds", 3))


def write_once(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch in a folder of its own, named by its number and replaced as
    a whole: a batch that is run again after a failure leaves no second copy."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("batch")
