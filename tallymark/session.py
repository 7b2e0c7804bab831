"""Reading tables, sizing partitions, and cutting lineage."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of (compressed) input that one Python task takes on, and tasks of a stage at most;
#: beyond that tasks take on more.
TASK_BYTES, MOST_TASKS = 16 << 20, 100_000
#: An estimate from here on means that Catalyst does not know the size.
UNKNOWN_BYTES = 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a scan that is the size of its files. Of a join, which
    Catalyst takes for a product, no more than its inputs have together."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return min(int(plan.stats().sizeInBytes()), sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))


def parts_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions so that each core gets work and tasks take on ``task_bytes``; for a plan of
    unknown size as many as the session shuffles into."""
    spark = df.sparkSession
    size = plan_bytes(df)
    wanted = math.ceil(size / task_bytes) if size < UNKNOWN_BYTES else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(2 * spark.sparkContext.defaultParallelism, wanted), MOST_TASKS)


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Round-robin where a scan has fewer splits than there are cores, and after a shuffle,
    whose partitions are sized for the JVM and not for Python."""
    run = df._jdf.queryExecution()
    if run.executedPlan().getClass().getSimpleName() != "AdaptiveSparkPlanExec":  # a plan with a shuffle would run here
        if run.toRdd().getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
            return df
    return df.repartition(parts_for(df, task_bytes))


def latest_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each ``key``: the one with the greatest ``order``.

    Ties on ``order`` go to the greatest row value, so the result is the same on
    every run. Rows with a null key count as one key.
    """
    rest = [c for c in columns if c != key]
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(c) for c in rest]))
    return df.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tallymark-checkpoint-")  # one machine, and gone with its process
            atexit.register(shutil.rmtree, folder, True)
            shared = f"file://{folder}"
        sc.setCheckpointDir(shared)
    return df.checkpoint()
