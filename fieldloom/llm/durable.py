"""Results that survive the loss of executors."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame


def folder(spark) -> str:
    """The checkpoint folder that all machines share.

    It is the session's ``spark.checkpoint.dir``; only a local session where that is
    unset (as in tests) gets one beside its warehouse.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, and cut from its lineage."""
    folder(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as Parquet and read again: for wide tables that are read in parts."""
    path = f"{folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
