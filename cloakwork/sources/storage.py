"""Tables in the folder that driver and executors share: cuts in the lineage that outlive executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without it (tests) gets a folder of its own, on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return os.path.dirname(held.get().rstrip("/"))
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="cloakwork-")
    spark.sparkContext.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES, whatever the rows' lengths, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes for each core up to which a table is dealt out anew before it is worked on.
SMALL_BYTES = 24 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small scan out over all cores: few row groups, or one, would keep a few tasks busy and leave the others empty.

    Small is what the plan says of its size, at most SMALL_BYTES for each core, so what is shuffled is bounded; a larger table has row groups enough.
    Whatever has a shuffle of its own stays as it is.
    """
    if df.isStreaming:
        return df
    small_batches(df.sparkSession)
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size > cores * SMALL_BYTES or plan.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(2 * cores)
