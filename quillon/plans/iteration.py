"""Lineage cuts and row numbering for iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            atexit.register(shutil.rmtree, folder := tempfile.mkdtemp(prefix="quillon-"), ignore_errors=True)
        sc.setCheckpointDir(named or folder)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small or iterated frame into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, removed when the driver exits."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            pass

    atexit.register(remove)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that is read several times as Parquet into the shared folder and read it back."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its counted size allows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def number_rows(df: DataFrame, name: str, *order: Column | str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order, without gathering the rows in one task.

    The rows are range-partitioned and sorted; a row's number is its place in its partition
    plus the sizes of the partitions before it (one small row per partition on the driver).
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    fixed = cut(ranged)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in fixed.groupBy(part.alias("part")).count().collect())
    offsets, total = [], start
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not offsets:
        return fixed.withColumn(name, F.lit(0).cast("long")).drop("__at")
    table = df.sparkSession.createDataFrame(offsets, "__part long, __before long")  # a row per partition
    return fixed.withColumn("__part", part).join(F.broadcast(table), "__part").withColumn(name, F.col("__before") + place).drop("__at", "__part", "__before")
