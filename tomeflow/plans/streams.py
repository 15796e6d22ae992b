"""Registered queries of timed state: a stream of two batches, the second with events older than the first's newest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import table as t
from ..streaming import events as V
from ..streaming import health as H

HOUR = 3_600_000
#: Hours that events come late, that a user stays suspect, and after which failures are forgotten.
LATE, SUSPECT, FORGET = 48, 24, 240


def stream_suspects(s, d):
    """Users that become suspect after two errors in a row, from events that come in batches, partly out of order."""
    shared = s.conf.get("spark.checkpoint.dir", None) or f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    path = f"{shared.rstrip('/')}/tomeflow/two-files-{uuid.uuid4().hex}"
    e = t(s, d, "events")
    middle = e.agg(F.timestamp_seconds(F.avg(F.unix_timestamp(F.col("ts").cast("timestamp")))).cast("timestamp_ntz").alias("middle"))
    e = e.crossJoin(F.broadcast(middle))  # one row
    first = (F.col("ts") < F.col("middle")) | (F.col("event_id") % 2 == 1) & (F.col("ts") < F.col("middle") + F.expr(f"INTERVAL {LATE // 2} HOURS"))
    e.where(first).drop("middle").write.mode("append").parquet(path)
    files = len(s.read.parquet(path).inputFiles())  # of the first batch
    e.where(~first).drop("middle").write.mode("append").parquet(path)
    stream = s.readStream.schema(V.EVENTS).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    with H.timed_state(s):
        return V.run_once(s, H.suspects(stream, f"{LATE} hours", 2, SUSPECT * HOUR, FORGET * HOUR), "append", shared)


SQL = {
    "stream_suspects": f"""
        WITH e AS (SELECT * FROM events WHERE ts <= (SELECT max(ts) - INTERVAL {LATE} HOURS FROM events) AND user_id IS NOT NULL AND event_id IS NOT NULL
        ), r AS (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e
        ), g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS before FROM r WHERE event_type = 'error'
        ), k AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL {FORGET} HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS spell FROM g
        ), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, spell ORDER BY ts, event_id) AS failures FROM k)
        SELECT user_id, event_id, CAST(failures AS INT) AS failures FROM n WHERE failures = 2 OR failures > 2 AND ts >= before + INTERVAL {SUSPECT} HOURS""",
}

QUERIES = {"stream_suspects": stream_suspects}
