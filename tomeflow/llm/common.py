"""Shared storage, blocks of documents and small helpers of the llm operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator here.
WORD_SEP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to Python at a time: texts differ in length too much for a number of rows to bound them.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Where it is unset, one below the warehouse, which is shared too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tomeflow/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs a reread only."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tomeflow_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by save() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tomeflow_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in Arrow batches of about BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _c_library():
    """The C library if it is the one that has both calls used here, or None."""
    try:
        lib = ctypes.CDLL(None)
        return lib if hasattr(lib, "malloc_trim") and hasattr(lib, "mallopt") else None
    except OSError:
        return None


#: mallopt's parameter for the least size of allocations that go back to the system when freed, and that size.
_MMAP_THRESHOLD, _LARGE = -3, 8 << 20


@functools.lru_cache(1)
def lean_memory() -> None:
    """From now on large arrays of this process go back to the system as soon as they are freed: a worker's two or
    three dead arrays are what the next one lacks."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    if lib := _c_library():
        lib.mallopt(_MMAP_THRESHOLD, _LARGE)


def free_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on, and the next stage needs it elsewhere."""
    lean_memory()
    if lib := _c_library():
        lib.malloc_trim(0)


def free_heaps(spark: SparkSession) -> None:
    """Have executors' JVMs collect garbage, so that heap which a stage has grown and left goes back to the system:
    Python workers of the next stage live beside the heap. A task a core, a second or so; changes no result."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).agg(F.count("x")).collect()


def tidy(run: Callable) -> Callable[[Iterator], Iterator]:
    """run, a function of an iterator of batches, with free_memory() at its end."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        lean_memory()
        yield from run(batches)
        free_memory()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame):
    """A hash of all values of a row but maps, to order or tell apart rows that share a key."""
    kinds = dict(df.dtypes)
    return F.xxhash64(F.lit("row"), *[F.col(f"`{c}`") for c in df.columns if "map<" not in kinds[c]])


def packed(df: DataFrame) -> DataFrame:
    """df as one column __r, so that columns added beside it never clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__r"))


def unpacked(df: DataFrame, columns: list[str], new: list[str]) -> DataFrame:
    """columns of __r and the new columns of df, which replace those of their names."""
    return df.select(*[F.col("__r").getField(c).alias(c) for c in columns if c not in new], *new)


def crc_fold(doc_id: str, folds: int):
    """crc32 of the decimal id modulo folds, the split all learned operators share."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)
