"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where no shared checkpoint folder is configured and the session runs on one machine.
LOCAL_CHECKPOINTS = "/tmp/tickweave-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as named by spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and continue from there (reliable checkpoint)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a job writes and rereads."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as no column of df begins with."""
    front = "_"
    while any(c.startswith(front) for c in df.columns):
        front += "_"
    return [front + n for n in names]


def as_given(df: DataFrame, other: DataFrame) -> DataFrame:
    """The columns that other has, in its order, whatever signs their names hold."""
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in other.columns])
