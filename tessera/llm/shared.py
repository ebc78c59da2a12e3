"""Small pieces that several operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.sources.tables import cut, table

__all__ = ["BROADCAST_ROWS", "aside", "back", "cut", "release", "table"]

#: Rows of a table that may be broadcast; above it the join is left to shuffle.
BROADCAST_ROWS = 100_000


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns renamed to __d0, __d1 and so on, and ``needed`` beside them under their names.

    Whatever else docs has, and however it is called, can't clash then; see ``back``.
    """
    renamed = docs.toDF(*[f"__d{i}" for i in range(len(docs.columns))])
    return renamed.withColumns({c: renamed[f"__d{docs.columns.index(c)}"] for c in needed})


def back(df: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of docs again, and ``added``."""
    return df.select(*[df[f"__d{i}"].alias(c) for i, c in enumerate(docs.columns)], *added)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that is made of them is written itself.

    A driver's garbage collection then lets Spark drop the shuffle files of the plans that went before.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()
