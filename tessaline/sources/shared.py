"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where that is unset and all runs on one machine, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessaline-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, and a lost executor loses no rows."""
    path = f"{shared_dir(df.sparkSession)}/tessaline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession, rows: int = 0, rows_per_task: int = 1) -> int:
    """How many tasks work that costs much more than its bytes is dealt to: all cores and all shuffle partitions, more for many rows. A number that is named isn't merged for being few bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """``df``, a settled table, dealt for such work."""
    return df.repartition(tasks_of(df.sparkSession, df.count(), rows_per_task))


class Scratch:
    """Settled tables of one run; those that nothing reads any more are deleted on request."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tessaline/{name}-{uuid.uuid4().hex}"
        self.number, self.held = 0, []

    def settle(self, df: DataFrame, tag: str, **options: str) -> DataFrame:
        self.number += 1
        path = f"{self.base}/{self.number}-{tag}"
        df.write.options(**options).parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((made, path))
        return made

    def keep(self, *tables: DataFrame) -> None:
        """Delete all settled tables but these. Call it only when no DataFrame that is still to run reads the others."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for made, folder in self.held:
            if not any(made is t for t in tables):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
        self.held = [(made, folder) for made, folder in self.held if any(made is t for t in tables)]
