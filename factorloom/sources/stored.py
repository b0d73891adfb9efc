"""Intermediate tables in the folder that all executors share, so that what is used several times is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where it is unset and the session runs in one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Tables:
    """Tables written as Parquet for a while; ``drop`` deletes them, and so does the end of a ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """``df``, written once; its columns are read as they are needed, and filters reach the files."""
        path = f"{self.folder}/{self.paths}"
        self.paths += 1
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        """Delete all tables but the last one."""
        for k in range(self.paths - 1):
            self._delete(f"{self.folder}/{k}")

    def drop(self) -> None:
        """Delete all tables; results that were built on them must have been written or collected before."""
        self._delete(self.folder)

    def _delete(self, place: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()
