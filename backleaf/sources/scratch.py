"""The folder that driver and executors share, for tables that a run makes on its way."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a folder in the session's warehouse, under which it is set then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    spark.conf.set("spark.checkpoint.dir", made)
    if spark.sparkContext.master.split("[")[0] == "local":
        atexit.register(shutil.rmtree, urlparse(run_folder(spark)).path, ignore_errors=True)
    return made


def run_folder(spark: SparkSession) -> str:
    """All that this application leaves in the shared folder."""
    return f"{shared_dir(spark)}/backleaf-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_run(spark: SparkSession) -> None:
    """Deletes the run's folder: for when no result is read any more."""
    delete(spark, run_folder(spark))
