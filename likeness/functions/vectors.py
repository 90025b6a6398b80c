"""Vector expressions that stay in the JVM (no Python in the row path)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (lambdas are not de-duplicated)."""
    return F.transform(F.array(value), body)[0]


def as_double(c) -> Column:
    return _col(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def l2(v) -> Column:
    """Unit length; a zero vector stays zero."""
    v = _col(v)
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def cosine(a, b) -> Column:
    a, b = _col(a), _col(b)
    return let(
        norm(a) * norm(b),
        lambda n: F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n)),
    )


def add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def standardise(v, mean, sd) -> Column:
    """``(v - mean) / sd``; a constant column keeps scale 1."""
    return F.zip_with(
        subtract(v, mean), _col(sd), lambda x, s: x / F.when(s == 0, 1.0).otherwise(s)
    )


def is_finite(v) -> Column:
    inf = float("inf")
    return F.coalesce(F.forall(_col(v), lambda x: ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def concat_vectors(*vs) -> Column:
    return F.concat(*[_col(v) for v in vs])


def pad_to(v, length) -> Column:
    """Trailing zeros up to ``length``; longer input is unchanged."""
    v = _col(v)
    need = F.greatest(F.lit(0), _col(length).cast("int") - F.size(v))
    return F.concat(v, F.array_repeat(F.lit(0.0), need))


def mono(channels) -> Column:
    """Mean over channels of an ARRAY<ARRAY<DOUBLE>> (one inner array per channel)."""
    channels = _col(channels)
    total = F.aggregate(
        F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))),
        channels[0],
        lambda acc, ch: F.zip_with(acc, ch, lambda x, y: x + y),
    )
    return let(F.size(channels).cast("double"), lambda n: F.transform(total, lambda x: x / n))


# Aggregates: mergeable buffers, so each task sends one vector per key, whatever the key's size.
def vector_sum(v) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(_col(v))))


def vector_mean(v) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(_col(v))))


def vector_moments(v) -> Column:
    """Struct(mean, variance, count); ``variance`` is the sample variance."""
    return Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(_col(v)))


# The same helpers for SQL text.
_SQL_FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_l2": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>",
               "transform(array(vec_norm(a)), n -> transform(a, x -> x / if(n = 0, 1D, n)))[0]"),
    "vec_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "vec_dot(vec_l2(a), vec_l2(b))"),
}


def register_sql_functions(spark) -> None:
    """Define ``vec_dot``, ``vec_norm``, ``vec_l2`` and ``vec_cosine`` as temporary SQL functions."""
    for name, (args, result, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
