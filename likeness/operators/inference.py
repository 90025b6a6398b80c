"""Batch inference with a user's own model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.streaming.incremental import pending


def encode(df: DataFrame, make_predict_fn: Callable, model: str, input_col: str = "v", dim: int | None = None,
           batch_size: int = 256, done: DataFrame | None = None, item: str = "item") -> DataFrame:
    """``item, model, v, error``: run a model over every row that it has not covered yet.

    ``make_predict_fn`` is called once per worker and returns a function from a NumPy batch to a
    NumPy batch. Rows whose output is not finite carry an error instead of a vector.
    """
    todo = df.withColumn("model", F.lit(model))
    if done is not None:
        todo = todo.join(pending(todo, done, ["model", item]), ["model", item], "left_semi")
    shape = [[dim]] if dim else None
    run = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=shape)
    out = todo.withColumn("_o", run(F.col(input_col)))
    finite = F.coalesce(F.forall("_o", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return out.select(item, "model", F.when(finite, F.col("_o")).alias("v"),
                      F.when(~finite, "the model returned a value that is not finite").alias("error"))
