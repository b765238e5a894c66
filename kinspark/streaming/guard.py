"""Signed requests that may be used once: state of each signature that ends by itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "signature string, request_id long, ts timestamp, accepted boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Reserve(StatefulProcessor):
    """Keeps until when a signature is taken; a timer at that time forgets it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        asked = frames[0] if len(frames) == 1 else pd.concat(frames)
        if len(asked) > 1:
            asked = asked.iloc[np.lexsort((asked["request_id"].to_numpy(), asked["micros"].to_numpy()))]
        held = self.until.get()
        held = None if held is None else held[0]
        taken, answers = held, []
        for micros in asked["micros"].tolist():
            fresh = taken is None or micros > taken
            answers.append(fresh)
            if fresh:
                taken = micros + self.ttl
        if taken != held:
            # an earlier timer is left to end: it finds the signature taken for longer
            self.until.update((taken,))
            self.handle.registerTimer(taken // 1000 + 1)
        yield pd.DataFrame({"signature": asked["signature"], "request_id": asked["request_id"], "ts": asked["ts"], "accepted": answers})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.until.get()
        if held is not None and held[0] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        yield pd.DataFrame(columns=["signature", "request_id", "ts", "accepted"])

    def close(self) -> None:
        pass


@contextmanager
def timed_state(spark: SparkSession):
    """The session's streams started inside keep state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def reserve(requests: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """A stream of requests (signature, request_id, ts), each with whether its signature was free.

    A signature that is let through is taken up to and including `ttl_seconds` later, by the
    requests' own times; the first request after that takes it again.  Requests of a batch go by
    time, then id.  A signature's state is one number, and goes when the watermark passes its end,
    so state grows with the requests of one TTL, not with the stream.  Requests behind the
    watermark (`late`) get no answer; null signatures and times neither.  Start it inside
    `timed_state`.
    """
    rows = requests.where("signature IS NOT NULL AND ts IS NOT NULL").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("signature").transformWithStateInPandas(statefulProcessor=_Reserve(ttl_seconds * 1_000_000), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def expired(reservations: DataFrame, as_of: str) -> DataFrame:
    """Reservations (signature, expires_at) that a purge at a time takes away; one that ends at that very time stays."""
    return reservations.where(F.col("expires_at") < F.lit(as_of).cast("timestamp"))
