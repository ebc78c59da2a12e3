"""Tables by name, and tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows in memory take about so many times the bytes of their files: short words that repeat leave under ten bytes of a row.
FILE_FACTOR = "20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where none is set, one beside the warehouse is taken if the session runs in this process alone, as in tests; on a
    cluster that could be each executor's own disk, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the cluster's shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
