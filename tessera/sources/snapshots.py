"""Sets of tables that are replaced as one: readers see all of the old or all of the new.

A snapshot's tables go to a folder of their own; only when all are written is it named, as the next number under
``commits``.  A name is one small file that appears when its job is committed, so a failure before that leaves what was
there.  Readers take the greatest number.  One writer at a time is assumed; a second one that picked the same number fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("version string, n bigint").json(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(number, folder) of the snapshot that holds, if there is one."""
    named = _commits(spark, root)
    last = None if named is None else named.orderBy(F.desc("n")).first()
    return None if last is None else (last["n"], f"{root}/versions/{last['version']}")


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Write the tables and then let them hold, in place of all that were there before; tells the snapshot's number."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    n = ((current(spark, root) or (0, ""))[0]) + 1
    spark.range(1).select(F.lit(version).alias("version")).write.json(f"{root}/commits/n={n}")
    return n


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the snapshot that holds now; a reader that has begun goes on with it, whatever is published since."""
    found = current(spark, root)
    if found is None:
        raise ValueError(f"nothing was published in {root}")
    return spark.read.parquet(f"{found[1]}/{name}")
