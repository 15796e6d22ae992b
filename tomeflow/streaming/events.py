"""Structured Streaming over the events table: windows, dedupe within a watermark, last write wins, circuits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; ts becomes a timestamp for watermarks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(EVENTS)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        raw = reader.parquet(f"{sf_dir}/events.parquet")
    else:  # a stream reads folders
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_of_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One event for each user and day."""
    return events.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "day"]).select("user_id", "day")


def last_write(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("p")).select("user_id", "p.event_id", "p.event_type")


def circuits(events: DataFrame, failures: int = 2) -> DataFrame:
    """(user_id, event_id) of events at which a user has failed so many times in a row; state lasts over batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for e in pd.concat(list(frames)).sort_values("event_id").itertuples():
            run = run + 1 if e.event_type == "error" else 0
            if run == failures:
                out.append((key[0], e.event_id))
        state.update((run,))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "run int", "append", "NoTimeout")


def run_once(spark: SparkSession, stream: DataFrame, mode: str, shared: str, fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that is there, written to a table and read back. Complete and update results keep the last batch's rows."""
    path = f"{shared.rstrip('/')}/tomeflow/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        # A batch that is tried again writes over what it wrote before.
        at = f"{path}/rows/epoch={epoch if mode == 'append' else 0}"
        (fold(batch) if fold else batch).write.mode("overwrite").parquet(at)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not rows.getFileSystem(spark._jsc.hadoopConfiguration()).exists(rows):  # the stream had no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
