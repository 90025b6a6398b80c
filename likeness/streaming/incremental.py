"""Incremental work: what is still to do, and replacing finished parts.

The engine has no event-time streams; its increments are keys, not windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Keys of ``work`` that no finished row covers."""
    todo = work.select(*keys).distinct()
    return todo if done is None else todo.join(done.select(*keys).distinct(), keys, "left_anti")


def replace_parts(df: DataFrame, path: str, key: str = "model", emptied: list[str] | None = None) -> None:
    """Replace the part of every key in ``df``; other parts stay. Keys in ``emptied`` lose theirs.

    Parts become visible one after the other and emptied ones go last; ``sources.versioned.commit`` publishes all
    of them at once.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    spark = df.sparkSession
    for value in emptied or []:
        p = spark._jvm.org.apache.hadoop.fs.Path(path, f"{key}={value}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and not df.filter(F.col(key) == value).limit(1).count():
            fs.delete(p, True)
