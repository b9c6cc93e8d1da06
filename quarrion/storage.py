"""Cutting lineage in the folder that all executors share, and joins that stay out of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a local session, whose driver is its only executor, uses a folder beside its warehouse; on a
    cluster no such folder is known to be shared, so the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def by_merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both.

    A side that grows with the input is not to be broadcast: adaptive execution goes by its compressed size, and rows that are
    alike take many times that in the driver.
    """
    return df.hint("merge")
