"""Episodes as a stream give the rows of the whole log, also after a failure."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators.episodes import account
from corpusmill.streaming import episodes, ingest



@pytest.fixture
def stream_session(spark):
    spark.conf.set(episodes.SETTING, episodes.PROVIDER)
    yield spark
    spark.conf.unset(episodes.SETTING)


def test_batches_restarts_and_a_batch_that_runs_twice(stream_session, tmp_path):
    spark = stream_session
    start = 1_700_000_000
    kinds = {"a": "vvp", "b": "cvcv", "c": "vvvvvvv", "d": "vc", "e": "p", "f": "cccc", "g": "vvpvv"}
    rows, n = [], 0
    for k in range(7):
        for user, word in enumerate(kinds.values()):
            if k < len(word):
                rows.append((n, start + n, user, word[k], float(50 if user in (2, 3) else 7 + n % 5)))
                n += 1
    log = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.col("s").cast("timestamp")).withColumn("props", F.lit("")).drop("s")
    calls = F.when(F.col("event_type") == "p", 0).when(F.col("event_type") == "c", 2).otherwise(1)
    want = sorted(map(tuple, account(log, ["user_id"], "event_id", calls, F.col("value"), max_calls=6, timeout=120.0).collect()))

    def run(part):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        found = episodes.account_stream(ingest.traces(spark, f"{tmp_path}/in"), ["user_id"], "event_id", "ts", calls, F.col("value"), max_calls=6, timeout=120.0, idle=60.0, late="1 hour")
        episodes.write_once(found, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()

    def have():
        return sorted(map(tuple, episodes.read_once(spark, f"{tmp_path}/out", f"user_id long, {episodes.RESULT}").where("user_id >= 0").collect()))

    run(log.where("event_id < 12"))
    run(log.where("event_id >= 12"))
    some = have()
    assert set(some) < set(want)  # those that have ended
    nobody = spark.createDataFrame([(10_000, -1, "v", 0.0, "")], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.lit(start + 100_000).cast("timestamp"))
    run(nobody)
    assert have() == want
    # the last batch was written but not committed: it runs again and leaves no second copy
    last = max(Path(tmp_path, "mark", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    run(nobody.limit(0))
    assert have() == want


def test_groups_of_episodes_and_nulls_give_the_rows_of_the_log(stream_session, tmp_path):
    spark = stream_session
    rng = np.random.default_rng(4)
    start, rows = 1_700_000_000, []
    for n in range(2000):
        kind, value = str(rng.choice(list("vvvvcp?"))), None if n % 11 == 0 else float(rng.integers(1, 60))
        rows.append((n, start + n, int(rng.integers(0, 150)), kind, value))
    log = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.col("s").cast("timestamp")).withColumn("props", F.lit("")).drop("s")
    calls = F.when(F.col("event_type") == "p", 0).when(F.col("event_type") == "c", 2).when(F.col("event_type") == "v", 1)
    want = sorted(map(tuple, account(log, ["user_id"], "event_id", calls, F.col("value"), max_calls=6, timeout=120.0).collect()))
    nobody = spark.createDataFrame([(10_000, -1, "v", 0.0, "")], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.lit(start + 100_000).cast("timestamp"))
    for part in (log.where("event_id < 700"), log.where("event_id >= 700"), nobody):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        found = episodes.account_stream(ingest.traces(spark, f"{tmp_path}/in"), ["user_id"], "event_id", "ts", calls, F.col("value"), max_calls=6, timeout=120.0, idle=60.0, late="1 hour", groups=3)
        episodes.write_once(found, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    have = episodes.read_once(spark, f"{tmp_path}/out", f"user_id long, {episodes.RESULT}").where("user_id >= 0").collect()
    assert sorted(map(tuple, have)) == want and len({r[1] for r in want}) == 3
