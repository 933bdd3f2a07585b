"""Tables that cut lineage: written to the cluster's shared checkpoint folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafwork-"))
    return context.getCheckpointDir()


class Scratch:
    """Written tables of one operator run; each can be dropped once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns a DataFrame that reads it: a later loss of an executor recomputes nothing before this point."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes the table behind a DataFrame that keep() returned."""
        path = getattr(df, "_scratch_path", None)
        if path:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop_all_but(self, *needed: DataFrame) -> None:
        """Deletes all tables of the run but those that the result still reads."""
        paths = {df._scratch_path for df in needed}  # none: everything goes
        for df in self.kept:
            if df._scratch_path not in paths:
                self.drop(df)
        self.kept = list(needed)
