"""Which labelled books get a task of the system: a plan that is the same whenever it is made from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(candidates: DataFrame, tasks: DataFrame, artifacts: DataFrame, policy: str, revision: str = "", most: int = 500) -> DataFrame:
    """(id, reason, enqueue_key) of candidates (id): those to be asked for, the `most` smallest ids, have a key, those
    with an active task or an artifact, tables of (id), the reason that they are skipped for, a task's before an
    artifact's. What is left beyond the limit waits for the next plan. Null ids have no part in it; repeated ones count
    once."""
    if not policy.strip():
        raise ValueError("a plan needs a policy")
    known = lambda t, c: t.where("id is not null").select("id").distinct().withColumn(c, F.lit(True))
    x = known(candidates, "asked").join(known(tasks, "task"), "id", "left").join(known(artifacts, "artifact"), "id", "left")
    x = x.select("id", F.when(F.col("task"), "task").when(F.col("artifact"), "artifact").alias("reason"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.lit(policy.strip()), F.lit(revision.strip()))
    first = x.where("reason is null").orderBy("id").limit(most).withColumn("enqueue_key", key)
    return first.unionByName(x.where("reason is not null").withColumn("enqueue_key", F.lit(None).cast("string")))
