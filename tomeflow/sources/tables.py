"""Readers: Parquet tables, tolerant JSON lines, regex-parsed logs and text cut into chapters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; Catalyst prunes columns and pushes filters into its scan. Its rows go to Python in bounded batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Where it is unset, one below the warehouse, which is shared too."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints").rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the cluster's shared folder and read back, so that it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/tomeflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at a time: texts and pages differ in length too much for a number of rows to bound them.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in Arrow batches of about BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that are no record are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """(ip, at, method, path, status, bytes) of a combined log, compressed or not; lines that don't parse are left out."""
    line = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)'
    part = lambda i: F.regexp_extract("value", line, i)
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(
        part(1).alias("ip"),
        F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("at"),
        part(3).alias("method"),
        part(4).alias("path"),
        part(5).cast("int").alias("status"),
        F.coalesce(part(6).try_cast("long"), F.lit(0)).alias("bytes"),
    )


def chapters(books: DataFrame, key: str, text: str, heading: str = r"^第[0-9一二三四五六七八九十百千零两]+[章回节卷]|^(?i)chapter [0-9]+") -> DataFrame:
    """(key, chapter, title, start_byte, end_byte): a total cover of each text's bytes by its headings.

    What stands before the first heading is chapter 0 without a title. Null texts have no chapters.
    """
    lines = books.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    size = F.octet_length("line") + 1
    lines = lines.withColumn("is_heading", F.col("line").rlike(heading))
    lines = lines.withColumn("chapter", F.sum(F.col("is_heading").cast("int")).over(w))
    lines = lines.withColumn("start_byte", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("is_last", F.lead("line_no").over(w).isNull())
    end = F.max(F.col("start_byte") + size - F.col("is_last").cast("int"))
    return lines.groupBy(key, "chapter").agg(
        F.max(F.when(F.col("is_heading"), F.trim("line"))).alias("title"), F.min("start_byte").cast("long").alias("start_byte"), end.cast("long").alias("end_byte")
    )
