"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a temporary folder of this session if all of it runs in
    this process (tests), and an error on a cluster, whose executors don't see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="nearopt-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/nearopt/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back; dropped() deletes it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.nearopt_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete a table of written() that no later step reads."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.nearopt_path)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
