"""Tables kept between jobs in the folder that a cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for removing a finished execution's shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a local folder in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder, seen by driver and executors, where operators keep tables between stages")
    return found or f"file://{tempfile.gettempdir()}/tessera-{os.getuid()}"


class Workspace:
    """Written tables that cut lineage: Parquet in the shared folder, read back.

    A lost executor costs only the stage that reads them. ``drop`` deletes what is consumed;
    the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self._count}-{name}"
        self._count += 1
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what was shuffled for a table goes once the table is written
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._tessera_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_tessera_path", None):
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass
