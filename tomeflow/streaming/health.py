"""Timed state over a stream: hosts that become suspect after failures in a row, in event order across batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUSPECTS = "user_id long, event_id long, failures int"


@contextlib.contextmanager
def timed_state(spark: SparkSession):
    """Within it streams keep their state in the provider that timers need; the setting from before comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


#: Shares of users; each is a key of the state.
SHARES = 1024
#: An event that waits for the watermark, and the health of a user with failures.
WAITING = np.dtype([("user_id", "<i8"), ("us", "<i8"), ("event_id", "<i8"), ("failed", "?")])
HEALTH = np.dtype([("user_id", "<i8"), ("failures", "<i4"), ("last", "<i8")])


class Suspects(StatefulProcessor):
    """Events wait until the watermark has passed them, so that a user's are taken in order of time and id.

    A failure counts up, any other event clears. A user that gets its `least`-th failure becomes suspect for
    suspect_ms from its last failure on; a later failure beyond that makes it suspect anew. Health is forgotten
    forget_ms after the last failure. Every call of state or timers goes to the JVM and back, so a key is a share of
    the users and not one, its state is one value, and it has a timer for each batch and not for each event.
    """

    def __init__(self, least: int, suspect_ms: int, forget_ms: int):
        self.least, self.suspect_ms, self.forget_ms = least, suspect_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType().add("health", T.BinaryType()).add("waiting", T.BinaryType()))

    def _get(self) -> tuple[bytes, bytes]:
        health, waiting = self.kept.get() or (b"", b"")
        return bytes(health), bytes(waiting)

    def _wait(self, events: np.ndarray) -> None:
        """A timer no later than the first event; one that comes too early finds nothing due."""
        self.handle.registerTimer(int(events["us"].min()) // 1000 - 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([np.rec.fromarrays([f[c] for c in WAITING.names], dtype=WAITING) for f in rows])
        health, waiting = self._get()
        self.kept.update((health, waiting + new.tobytes()))
        self._wait(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        health, waiting = self._get()
        users = {u: (n, last) for u, n, last in np.frombuffer(health, HEALTH).tolist()}
        events = np.frombuffer(waiting, WAITING)
        passed = events["us"] <= now * 1000
        due, rest = events[passed], events[~passed]
        out = []
        # An event that comes twice is one.
        for (user, us, event_id), failed in sorted({e[:3]: e[3] for e in due.tolist()}.items()):
            failures, last = users.get(user, (0, 0))
            if not failed:
                users.pop(user, None)
                continue
            if failures and us - last >= self.forget_ms * 1000:
                failures = 0
            was = failures >= self.least and us - last < self.suspect_ms * 1000
            users[user] = failures + 1, us
            if failures + 1 >= self.least and not was:
                out.append((user, event_id, failures + 1))
        gone = {u: last // 1000 + self.forget_ms + 1 for u, (_, last) in users.items()}
        left = [(u, *users[u]) for u, at in gone.items() if now < at]
        if left:
            self.handle.registerTimer(min(gone[u] for u, _, _ in left))
        if len(rest):
            self._wait(rest)
        if left or len(rest):
            self.kept.update((np.array(left, dtype=HEALTH).tobytes(), rest.tobytes()))
        else:
            self.kept.clear()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "failures"]).astype({"user_id": "int64", "event_id": "int64", "failures": "int32"})

    def close(self) -> None:
        pass


def suspects(events: DataFrame, late: str, least: int = 2, suspect_ms: int = 600_000, forget_ms: int = 86_400_000) -> DataFrame:
    """(user_id, event_id, failures) of events (event_id, ts, user_id, event_type) at which a user becomes suspect.

    Events up to `late` behind the newest are put in order; later ones go. Rows with a null user, id or time are
    left out, as they have no key or place. An event that comes twice counts once.
    """
    x = events.where("user_id is not null and event_id is not null and ts is not null").withWatermark("ts", late)
    x = x.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"), F.pmod(F.xxhash64("user_id"), F.lit(SHARES)).cast("int").alias("share"))
    return x.groupBy("share").transformWithStateInPandas(statefulProcessor=Suspects(least, suspect_ms, forget_ms), outputStructType=SUSPECTS, outputMode="Append", timeMode="EventTime")
