"""Signatures that may be used once: several batches, restarts, and state that ends."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from kinspark.streaming import guard

START = datetime.datetime(2024, 5, 1)
SCHEMA = "signature string, request_id long, ts timestamp"


def test_signature_is_free_again_after_its_time(spark, tmp_path):
    source, told, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{told}/batch={number}")

    def run(k, *rows):
        """A batch of (signature, id, minute), by a stream that starts from its checkpoint."""
        spark.createDataFrame([(s, i, None if m is None else START + datetime.timedelta(minutes=m)) for s, i, m in rows], SCHEMA).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        with guard.timed_state(spark):
            guard.reserve(stream, 300, "1 minute").writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {r["request_id"]: r["accepted"] for r in spark.read.schema(guard.OUT).parquet(told).collect()}

    def held():
        return {r[0] for r in spark.read.format("statestore").option("stateVarName", "until").load(checkpoint).select(F.col("key.signature")).collect()}

    before = spark.conf.get(guard.PROVIDER)
    assert run(0, ("a", 1, 0), ("a", 2, 3), ("b", 3, 1), (None, 4, 1), ("c", 5, None), ("a", 6, 0)) == {1: True, 2: False, 3: True, 6: False}
    assert held() == {"a", "b"}
    # a is taken until minute 5 itself; another batch, another start of the stream
    assert run(1, ("a", 7, 5), ("d", 8, 5))[7] is False
    answers = run(2, ("a", 9, 6), ("a", 10, 7), ("d", 11, 6))
    assert (answers[9], answers[10], answers[11]) == (True, False, False)
    # far later: the others' state is over, and their signatures are free
    answers = run(3, ("z", 12, 60))
    assert answers[12] is True and held() == {"z"}
    assert run(4, ("a", 13, 61))[13] is True
    assert spark.conf.get(guard.PROVIDER) == before


def test_purge(spark):
    rows = spark.createDataFrame([("a", START), ("b", START + datetime.timedelta(seconds=1)), ("c", None)], "signature string, expires_at timestamp")
    assert [r["signature"] for r in guard.expired(rows, str(START + datetime.timedelta(seconds=1))).collect()] == ["a"]


class Counted:
    """A handle and a value that count what a signature's state is asked."""

    def __init__(self):
        self.calls, self.value = 0, None

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1

    def deleteTimer(self, at):
        self.calls += 1

    def listTimers(self):
        self.calls += 1
        return iter(())


def test_a_signature_costs_three_calls_and_an_early_timer_leaves_its_state():
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

    one, state = guard._Reserve(1000), Counted()
    one.handle = one.until = state
    frame = pd.DataFrame({"signature": ["a"] * 3, "request_id": [2, 1, 3], "ts": [START] * 3, "micros": [5000, 5000, 6001]})
    (told,) = one.handleInputRows(("a",), iter([frame]), None)
    assert dict(zip(told["request_id"], told["accepted"])) == {1: True, 2: False, 3: True} and state.value == (7001,) and state.calls == 3
    list(one.handleExpiredTimer(("a",), None, ExpiredTimerInfo(7)))
    assert state.value == (7001,)
    list(one.handleExpiredTimer(("a",), None, ExpiredTimerInfo(8)))
    assert state.value is None
