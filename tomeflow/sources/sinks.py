"""Writers: upserts, inserts of what is absent, guarded replacement, volumes of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current with incoming rows laid over it by key; an incoming null leaves the current value."""
    c, i = current.alias("c"), incoming.alias("i")
    on = [F.col(f"c.{k}") == F.col(f"i.{k}") for k in keys]
    joined = c.join(i, on, "full")
    cols = [F.coalesce(f"i.{n}", f"c.{n}").alias(n) if n in incoming.columns else F.col(f"c.{n}") for n in current.columns]
    return joined.select(*cols)


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current and those incoming rows whose key it lacks; of incoming rows with one key, one."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current, keys, "left_anti").select(*current.columns))


def replace_guarded(new: DataFrame, path: str, guard: Column, message: str) -> None:
    """Overwrite a table unless some row fails the guard; then nothing is committed."""
    checked = new.withColumn("__ok", F.when(guard, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    checked.where("__ok").drop("__ok").write.mode("overwrite").parquet(path)


def drift(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys on one side only, or 'differs' where other columns do."""
    others = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*others).alias("__a"))
    y = b.select(*keys, F.struct(*others).alias("__b"))
    j = x.join(y, keys, "full")
    side = F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return j.select(*keys, side.alias("side")).where("side is not null")


def volumes(rows: DataFrame, key: str, order: str, size: str, capacity: int) -> DataFrame:
    """rows with volume and volume_offset: each key's rows in order, next-fit, whole; what fits no volume has its own.

    Next-fit is a walk in order, so a key's rows pass one task; they are sorted outside memory and stream through in
    batches, and only the place in the current volume is held. Null sizes are 0; ties follow the order's column only.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, volume, used, begun = None, 0, 0, False
        for f in frames:
            at = []
            for k, n in zip(f[key].tolist(), f[size].fillna(0).astype("int64").tolist(), strict=True):
                if not begun or k != now and not (k is None and now is None):
                    now, volume, used, begun = k, 0, 0, True
                elif used and used + n > capacity:
                    volume, used = volume + 1, 0
                at.append((volume, used))
                used += n
            yield f.assign(volume=[v for v, _ in at], volume_offset=[o for _, o in at])

    schema = T.StructType([*rows.schema.fields, T.StructField("volume", T.LongType()), T.StructField("volume_offset", T.LongType())])
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(walk, schema)
