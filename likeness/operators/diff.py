"""Comparing two tables cell by cell, and two keyed inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.settings import STAMP_COLUMNS


def _cells(df: DataFrame, keys: list[str], cols: list[str], out: str) -> DataFrame:
    cells = F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols]))
    return df.select(*keys, cells.alias(out), F.lit(True).alias(f"_in_{out}"))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], ignore: list[str] | None = None) -> DataFrame:
    """``column, n_different, first_key, left_value, right_value`` for every column that differs.

    Rows on one side only are reported under the column ``__row__``. Stamp columns do not count.
    """
    skip = set(ignore if ignore is not None else STAMP_COLUMNS) | set(keys)
    lc, rc = [[c for c in d.columns if c not in skip] for d in (left, right)]
    if sorted(lc) != sorted(rc):
        raise ValueError(f"the tables hold different columns: {sorted(set(lc) ^ set(rc))}")
    both = _cells(left, keys, lc, "l").join(_cells(right, keys, lc, "r"), keys, "full_outer")
    whole = F.struct(
        F.lit("__row__").alias("column"),
        F.when(F.col("_in_l"), "present").otherwise("absent").alias("lv"),
        F.when(F.col("_in_r"), "present").otherwise("absent").alias("rv"))
    cells = [F.struct(F.lit(c).alias("column"), F.col("l")[c].alias("lv"), F.col("r")[c].alias("rv")) for c in lc]
    matched = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    long = both.withColumn(
        "c", F.explode(F.when(matched, F.array(*cells) if cells else F.array(whole)).otherwise(F.array(whole)))
    ).filter(~F.col("c.lv").eqNullSafe(F.col("c.rv")))
    first = F.struct(*keys)
    return long.groupBy("c.column").agg(
        F.count("*").alias("n_different"),
        F.min_by(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), first).alias("first_key"),
        F.min_by(F.col("c.lv"), first).alias("left_value"), F.min_by(F.col("c.rv"), first).alias("right_value"))


def inventory_diff(recorded: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status, recorded, current`` of entries that are changed, absent or added."""
    l = recorded.select(key, F.col(value).alias("recorded"), F.lit(True).alias("_l"))  # noqa: E741
    r = current.select(key, F.col(value).alias("current"), F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "absent").when(F.col("_l").isNull(), "added")
        .when(~F.col("recorded").eqNullSafe(F.col("current")), "changed"))
    return l.join(r, key, "full_outer").select(key, status.alias("status"), "recorded", "current").filter(
        F.col("status").isNotNull())


def same_content(left: DataFrame, right: DataFrame) -> bool:
    """Do two tables hold the same bag of rows?"""
    cols = left.columns
    if sorted(cols) != sorted(right.columns):
        return False
    l, r = left, right.select(*cols)  # noqa: E741
    return not l.exceptAll(r).limit(1).count() and not r.exceptAll(l).limit(1).count()


def determinism(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``outcome, n_columns, n_different`` of two runs of one query."""
    d = table_diff(first, second, keys)
    n = len([c for c in first.columns if c not in set(keys) | set(STAMP_COLUMNS)])
    return d.agg(F.count("*").alias("n_different")).select(
        F.when(F.col("n_different") == 0, "pass").otherwise("fail").alias("outcome"),
        F.lit(n).alias("n_columns"), "n_different")
