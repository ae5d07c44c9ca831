"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a batch between Spark and Python at most, as texts are long.
BATCH_ROWS = 2000
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_code(spark: SparkSession) -> None:
    """Python workers that start from now on find this package, wherever the driver was started, and give memory back that they don't use."""
    env = spark.sparkContext.environment
    env.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1000000"})
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, str(BATCH_ROWS))
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)


def with_checkpoints(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder among the checkpoints."""
    with_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def any_of(spark: SparkSession, pattern: str) -> bool:
    """Whether a path matches."""
    path, system = _path(spark, pattern)
    return len(system.globStatus(path) or []) > 0


def remove(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Now, or when the driver ends."""
    path, system = _path(spark, folder)
    if at_exit:
        system.deleteOnExit(path)
    else:
        system.delete(path, True)


def rename(spark: SparkSession, folder: str, to: str) -> None:
    """In one step, as far as the file system has one."""
    path, system = _path(spark, folder)
    if not system.rename(path, _path(spark, to)[0]):
        raise OSError(f"{folder} could not become {to}")


class Tables:
    """Tables in the shared folder; what led to them is free to go, so lost executors cost one step and disk stays bounded. What is left goes when the driver ends."""

    #: Spark deletes the shuffle files of a query when it ends.
    CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid4()}"
        remove(spark, self.folder, at_exit=True)

    def kept(self, name: str, rows: DataFrame) -> DataFrame:
        before = self.spark.conf.get(self.CLEANED, "false")
        self.spark.conf.set(self.CLEANED, "true")
        try:
            rows.write.parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(self.CLEANED, before)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, deal: Column | None = None) -> DataFrame:
    """left with the columns of right, whose keys are distinct, or nulls. No key of hot makes a large task, however many rows left has of it.

    hot(key, ...) are the rows of right with the most partners; the caller bounds their number and size. They go to every
    task, and their rows of left are dealt out evenly in the join with the others: by their places, or by deal (a long of
    left, 0 or more) where left comes from a shuffle, whose order a repeated task may change. right is read twice.
    """
    fields = [c for c in right.columns if c != key]
    near = hot.select(F.col(key).alias("_near_key"), F.struct(*fields).alias("_near"))
    told = left.join(F.broadcast(near), F.col(key) == F.col("_near_key"), "left").drop("_near_key")
    told = told.withColumn("_deal", F.when(F.col("_near").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() % 1_000_003 + 1 if deal is None else deal + 1))
    far = right.select(F.col(key).alias("_far_key"), F.lit(0).cast("long").alias("_zero"), F.struct(*fields).alias("_far"))
    both = told.join(far, (F.col(key) == F.col("_far_key")) & (F.col("_deal") == F.col("_zero")), "left")
    return both.select(*left.columns, F.coalesce("_near", "_far").alias("_x")).select(*left.columns, *[F.col("_x")[f].alias(f) for f in fields])


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row though body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; null: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")
