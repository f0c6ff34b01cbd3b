"""Session defaults and the shared-storage workspace that cuts lineage between iterative steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerlink", master: str | None = None, shuffle: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings the engine is written for; cluster defaults win where set outside.

    ``shared`` names the folder all machines see; without it the cluster's ``spark.checkpoint.dir`` holds.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.  Only a single-machine session that names none (tests) gets one made.

    On a cluster a folder of one machine would be written by each executor for itself and read back with gaps,
    so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitions in the session's full number, for steps whose work is large for their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Workspace:
    """Writes intermediate tables as Parquet under the shared folder and reads them back.

    A written table cuts lineage, survives the loss of executors, and unlike a row checkpoint keeps
    column pruning, filter pushdown and a size the optimizer can use for its join choice.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"ledgerlink-{uuid.uuid4().hex}")
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete every table of this workspace.  Call it only after the results are written out."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
