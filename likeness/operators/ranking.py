"""Ranks and running totals that never sort one key's rows in one task.

Rows are ordered by a hex digest. Its first digits cut every key into up to ``16**prefix``
slices; a slice is ranked on its own and shifted by the total of the slices before it. A key
that holds a third of the table is therefore spread over all slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.session import bounded

PREFIX = 3
PRUNED_ROWS = 1000      # the longest ranking that Spark prunes before its shuffle


def running_total(df: DataFrame, by: list[str], key: Column, out: str, value: Column | None = None,
                  tie: list[str] | None = None, prefix: int = PREFIX) -> DataFrame:
    """Add ``out``: the sum of ``value`` (default 1) over earlier rows of the same ``by`` key."""
    value = F.lit(1) if value is None else value
    d = df.withColumn("_k", key).withColumn("_s", F.left("_k", F.lit(prefix))).withColumn("_x", value)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    slices = d.groupBy(*by, "_s").agg(F.sum("_x").alias("_x"))
    slices = slices.withColumn(
        "_o",
        F.coalesce(F.sum("_x").over(
            Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_x")
    inner = Window.partitionBy(*by, "_s").orderBy("_k", *(tie or [])).rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("_i", F.coalesce(F.sum("_x").over(inner), F.lit(0)))
    return (
        d.join(slices, [*by, "_s"])
        .withColumn(out, F.col("_o") + F.col("_i"))
        .drop("_k", "_s", "_x", "_o", "_i")
    )


def hash_rank(df: DataFrame, by: list[str], key: Column, out: str = "rank",
              tie: list[str] | None = None) -> DataFrame:
    """1-based rank in digest order within ``by``."""
    return running_total(df, by, key, out, tie=tie).withColumn(out, F.col(out) + 1)


def first_by_key(df: DataFrame, by: list[str], key: Column, n: int, tie: list[str]) -> DataFrame:
    """The first ``n`` rows of each key in digest order.

    Spark prunes a ``row_number() <= n`` window of up to ``PRUNED_ROWS`` before its shuffle, so a hot key
    sends at most ``n`` rows per task. For a larger ``n`` slices of digests are counted first, and only rows
    of the slices in which the first ``n`` lie are sorted: ``n`` and a slice, not the whole key.
    """
    w = Window.partitionBy(*by).orderBy("_k", *tie)
    d = df.withColumn("_k", key)
    if n > PRUNED_ROWS:
        d = _first_slices(d, by, n)
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_k", "_r")


def _first_slices(d: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of the slices of ``_k`` that start before a key's row ``n``."""
    own = [f"_by{i}" for i in range(len(by))]
    slices = d.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own)], F.left("_k", F.lit(PREFIX)).alias("_s")).agg(F.count("*").alias("_x"))
    before = Window.partitionBy(*own).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    last = slices.withColumn("_o", F.coalesce(F.sum("_x").over(before), F.lit(0))).filter(F.col("_o") < n)
    last = bounded(last.groupBy(*own).agg(F.max("_s").alias("_last")))
    same = F.lit(True)
    for c, o in zip(by, own):
        same &= F.col(c).eqNullSafe(F.col(o))
    return d.join(last, same).filter(F.left("_k", F.lit(PREFIX)) <= F.col("_last")).drop(*own, "_last")


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rank with ties averaged, for small result tables."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2.0)
