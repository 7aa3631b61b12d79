"""Session helpers: shared scratch space, worker import path, text-safe Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Long texts share an Arrow batch, so batches are bounded by bytes as well as by rows.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20

#: Bytes of a table's files for each partition of a shuffle, some 200,000 line items, and bytes up to which partitions are joined and files are read by a task.
PART_BYTES = 4 << 20
JOINED_BYTES = 16 << 20
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and bound Arrow batches. Idempotent."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="lexgrid-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and stays columnar."""
    path = f"{shared_dir(df.sparkSession)}/lexgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The number of partitions that a shuffle starts with."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled") == "true"
    return int((spark.conf.get(INITIAL_PARTS, None) if adaptive else None) or spark.conf.get("spark.sql.shuffle.partitions"))


def held(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key as a shuffle would deal it and kept on the executors' disks, so that joins on key don't shuffle it again.

    What a lost executor held is computed again. The caller ends it with unpersist(). The count fills it: before that,
    adaptive plans don't know how it is dealt.
    """
    kept = df.repartition(parts(df.sparkSession), key).persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame) -> DataFrame:
    """df; shuffles start with a partition for each PART_BYTES of it at least, so that a task's share doesn't grow with the table.

    Adaptive execution joins small partitions, up to JOINED_BYTES. The size is that of the files; nothing is read.
    """
    conf = df.sparkSession.conf
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if conf.get("spark.sql.adaptive.enabled") == "true":
        if -(-size // PART_BYTES) > parts(df.sparkSession):
            conf.set(INITIAL_PARTS, str(-(-size // PART_BYTES)))
        conf.set(ADVISED, str(JOINED_BYTES))
        conf.set("spark.sql.files.maxPartitionBytes", str(JOINED_BYTES))
    return df


def placed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key into parts of about `rows` rows, as many as its size asks for.

    For steps that make much of little: parts sized by what is shuffled would be too large for what is sorted after it.
    """
    number = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(number, key)
