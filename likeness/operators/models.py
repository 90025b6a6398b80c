"""Model tables: one row of weights per fit, applied to all rows in one pass.

``fit_models`` fits in tasks, for cells whose rows fit one; larger cells are fitted in passes (``operators/passes.py``).
Applying a model knows no bound: rows are cut into blocks, each block meets its model's row once, and nothing
passes through the driver. ``fit_sample`` draws rows by digest, so a retried task sees the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.text import draw_key
from likeness.operators.similarity import _arrow
from likeness.session import bounded, spread

FIT_ROWS = 20_000
LEAST_PER_CLASS = 64
BLOCK_ROWS = 4096


def fit_sample(rows: DataFrame, cell: list[str], label: str, item: list[str], purpose: str, fit_rows: int = FIT_ROWS,
               least: int = LEAST_PER_CLASS) -> DataFrame:
    """Rows to fit on, with ``_weight``, the number of rows each one stands for.

    A cell within ``fit_rows`` keeps every row with weight 1. A larger one keeps the share
    ``fit_rows / rows`` of each class, but ``least`` rows of a rare class in expectation: about ``fit_rows`` plus
    ``least`` per class in all.
    """
    classes = rows.groupBy(*cell, label).agg(F.count("*").alias("_n"))
    totals = classes.groupBy(*cell).agg(F.sum("_n").alias("_total"))
    shares = classes.join(totals, cell).select(
        *cell, label, F.least(F.lit(1.0), F.greatest(fit_rows / F.col("_total"), least / F.col("_n"))).alias("_share"))
    draw = F.conv(F.left(draw_key(purpose, *item), F.lit(12)), 16, 10).cast("double") / float(16 ** 12)
    return rows.join(bounded(shares), [*cell, label]).where(draw < F.col("_share")).withColumn(
        "_weight", 1.0 / F.col("_share")).drop("_share")


def fit_models(rows: DataFrame, cell: list[str], fields: list[T.StructField],
               fit: Callable[[pa.Table], dict | None]) -> DataFrame:
    """One model row per cell: ``fit`` gets the cell's rows and returns the ``fields``, or None for no model."""
    schema = T.StructType([rows.schema[c] for c in cell] + fields)
    arrow = _arrow(schema)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = fit(group)
        if found is None:
            return arrow.empty_table()
        return pa.Table.from_pylist([{**{c: k.as_py() for c, k in zip(cell, key)}, **found}], schema=arrow)

    return spread(rows, cell).groupBy(*cell).applyInArrow(run, schema)


def apply_models(rows: DataFrame, models: DataFrame, on: list[str], item: list[str], fields: list[T.StructField],
                 run: Callable[[pa.Table, dict], dict], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``run`` on every block of rows with its model's row; ``rows`` without vectors it does not name, plus ``fields``.

    ``run`` gets a block and the model as a dict and returns the values of ``fields``. Rows of cells
    without a model are left out.
    """
    blocks = bounded(rows.groupBy(*on).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks")))
    dealt = rows.join(blocks, on).withColumn("_b", F.pmod(F.xxhash64(*item), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = models.join(blocks, on).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    keep = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.ArrayType)]
    schema = T.StructType([rows.schema[c] for c in keep] + fields)
    arrow = _arrow(schema)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        found = run(left, right.slice(0, 1).to_pylist()[0])
        return pa.table({**{c: left[c] for c in keep}, **found}, schema=arrow)

    key = [*on, "_b"]
    dealt, copies = dealt.toDF(*dealt.columns), copies.toDF(*copies.columns)
    return spread(dealt, key).groupBy(*key).cogroup(spread(copies, key).groupBy(*key)).applyInArrow(block, schema)
