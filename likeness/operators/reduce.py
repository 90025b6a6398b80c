"""Optional principal components of standardised vectors.

One aggregation adds up the Gram matrix of every cell by strips of its rows; a cell's strips meet in
one task of dim x dim numbers, whatever the number of rows, and leave it as a row of a model table. All
rows are then projected from that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.vectors import vector_sum
from likeness.operators.models import apply_models, fit_models
from likeness.operators.similarity import _arrow, picked
from likeness.session import one_thread_per_task

STRIP = 64              # rows of the Gram matrix that travel together
HELD_BYTES = 64 << 20   # open sums of a task
MODEL = "w array<double>, variances array<double>, total double, n long, dim int"


def gram(rows: DataFrame, cell: list[str], x: str = "x") -> DataFrame:
    """``cell, strip, s, n``: sums of outer products, ``STRIP`` rows of the matrix to a row of the table."""
    schema = T.StructType([rows.schema[c] for c in cell] + [
        T.StructField("strip", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush():
            out = {name: [] for name in schema.fieldNames()}
            for key, (m, n) in held.items():
                for strip, start in enumerate(range(0, len(m), STRIP)):
                    for c, k in zip(cell, key):
                        out[c].append(k)
                    out["strip"].append(strip)
                    out["s"].append(m[start:start + STRIP].ravel())
                    out["n"].append(n)
            held.clear()
            return pa.Table.from_pydict(out, schema=arrow).to_batches()

        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in cell])) if cell else [()] * b.num_rows
            at: dict[tuple, list] = {}
            for i, key in enumerate(keys):
                at.setdefault(key, []).append(i)
            for key, index in at.items():
                v = picked(b.column(x), np.asarray(index))
                m, n = held.get(key, (0.0, 0))
                held[key] = [m + v.T @ v, n + len(v)]
            if sum(m.nbytes for m, _ in held.values()) > HELD_BYTES:
                yield from flush()
        if held:
            yield from flush()

    parts = rows.select(*cell, x).mapInArrow(run, schema)
    return parts.groupBy(*cell, "strip").agg(vector_sum("s").alias("s"), F.sum("n").alias("n"))


def component_models(rows: DataFrame, cell: list[str], components: int, x: str = "x", is_train: str = "is_train") -> DataFrame:
    """The model table: per cell ``w`` (dim x kept, row by row), ``variances`` kept, their ``total``, ``n``, ``dim``.

    At most ``min(components, n - 1, dim)`` components are kept. Train columns have zero mean after
    standardisation, so no further centring is needed. A component's largest weight is positive.
    """
    one_thread_per_task(rows)

    def fit(group: pa.Table) -> dict:
        order = np.argsort(np.asarray(group["strip"]))
        flat = np.concatenate([np.asarray(group["s"][int(i)].as_py()) for i in order])
        d, n = int(np.sqrt(len(flat))), group["n"][0].as_py()
        values, vectors = np.linalg.eigh(flat.reshape(d, d) / max(n - 1, 1))
        keep = np.argsort(-values, kind="stable")[:max(min(components, n - 1, d), 0)]
        w = vectors[:, keep]
        w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)
        return {"w": w.ravel().tolist(), "variances": np.maximum(values[keep], 0.0).tolist(), "total": float(values.sum()),
                "n": n, "dim": d}

    return fit_models(gram(rows.filter(is_train), cell, x), cell, T._parse_datatype_string(MODEL).fields, fit)


def principal_components(rows: DataFrame, cell: list[str], components: int, x: str = "x", is_train: str = "is_train",
                         item: list[str] | None = None) -> DataFrame:
    """``x`` projected on the leading components of the cell's train rows; other vector columns are left out."""
    models = component_models(rows, cell, components, x, is_train)
    item = item or [c for c in rows.columns if c not in cell and not isinstance(rows.schema[c].dataType, T.ArrayType)]

    def run(block: pa.Table, model: dict) -> dict:
        w = np.reshape(model["w"], (model["dim"], -1))
        return {x: pa.array(list(picked(block[x], np.arange(block.num_rows)) @ w), pa.list_(pa.float64()))}

    return apply_models(rows, models, cell, item, [T.StructField(x, T.ArrayType(T.DoubleType()))], run)
