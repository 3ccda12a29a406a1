"""Checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only where it is unset, in local mode, make one."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as a URI that Spark can write to."""
    ensure_checkpoint_dir(spark)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get())


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder; the result survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
