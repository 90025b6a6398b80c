"""Templates, fold statistics and pooled queries from mergeable partial sums."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.vectors import l2, subtract, vector_mean, vector_moments, vector_sum
from likeness.session import bounded


def _is_constant(n, mean, var):
    """A variance that rounding of ``n`` equal values could have produced."""
    m = F.least(n, F.lit(1e6)) * 2.220446049250313e-16
    return F.isnan(var) | (var <= m * var + F.pow(m * mean, 2))


def item_means(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """One mean vector per item (windows -> item)."""
    return df.groupBy(*keys).agg(vector_mean(v).alias(v))


def fold_sums(df: DataFrame, by: list[str], label: str = "ind", v: str = "v") -> DataFrame:
    """``by, label, fold, s, n``: the sum of unit vectors and the row count. The only pass over rows
    that templates and enrolment rules need."""
    sums = df.groupBy(*by, label, "fold").agg(vector_sum(l2(v)).alias("s"), F.count("*").alias("n"))
    return bounded(sums, max_rows=16_384)


def enrolled(sums: DataFrame, by: list[str], label: str = "ind") -> DataFrame:
    """``by, fold`` of folds whose train side holds every label.

    A label is missing from a fold's train side when all its rows lie in that fold. ``sums`` has
    one row per label and fold.
    """
    totals = sums.groupBy(*by, label).agg(F.sum("n").alias("_t"))
    held = sums.select(*by, label, "fold", "n").join(bounded(totals, source=sums), [*by, label])
    folds = held.groupBy(*by, "fold").agg(F.count_if(F.col("n") == F.col("_t")).alias("_missing"))
    return bounded(folds.filter(F.col("_missing") == 0).drop("_missing"), source=sums)


def fold_templates(sums: DataFrame, by: list[str], label: str = "ind") -> DataFrame:
    """Train templates ``by, fold, label, t`` from ``fold_sums``.

    The train side of a fold is the label's total minus that fold's own sum, so no row is visited
    once per fold. The unit mean and the unit sum are the same vector. Labels without train rows
    in a fold have no template there.
    """
    own = sums.select(*by, label, "fold", F.col("s").alias("_s"), F.col("n").alias("_n"))
    per_label = own.groupBy(*by, label).agg(vector_sum("_s").alias("_t"), F.sum("_n").alias("_tn"))
    folds = own.groupBy(*by).agg(F.array_sort(F.collect_set("fold")).alias("_f"))
    spread = per_label.join(bounded(folds, source=sums), by).withColumn("fold", F.explode("_f")).drop("_f")
    return (
        spread.join(own, [*by, label, "fold"], "left")
        .filter(F.col("_tn") > F.coalesce("_n", F.lit(0)))
        .select(*by, "fold", label,
                l2(F.when(F.col("_s").isNull(), F.col("_t")).otherwise(subtract("_t", "_s"))).alias("t"))
    )


def templates(df: DataFrame, by: list[str], label: str = "ind", v: str = "v") -> DataFrame:
    """Unit mean of the given vectors per label."""
    return df.groupBy(*by, label).agg(l2(vector_sum(v)).alias("t"))


def pooled_queries(df: DataFrame, by: list[str], label: str = "ind", grp: str = "grp", v: str = "v") -> DataFrame:
    """One unit query per (individual, group): a group may hold two individuals."""
    return df.groupBy(*by, label, grp).agg(l2(vector_sum(v)).alias(v))


def fold_scalers(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Train mean and population SD per fold: ``by, fold, mean, sd``.

    Each fold is summarised once; the train side merges (count, mean, squared deviation) of the
    other folds, which stays accurate where subtracting sums of squares would not.
    """
    one = df.groupBy(*by, "fold").agg(vector_moments(v).alias("_m")).select(
        *by, "fold",
        F.col("_m.count").cast("double").alias("n"),
        vector_to_array("_m.mean").alias("m"),
        vector_to_array("_m.variance").alias("s2"),
    )
    one = bounded(one, max_rows=16_384)
    wide = one.select(*by, "fold", F.posexplode(F.arrays_zip("m", "s2")).alias("d", "z"), "n").select(
        *by, "fold", "d", "n", F.col("z.m").alias("m"),
        (F.col("z.s2") * F.greatest(F.col("n") - 1, F.lit(0.0))).alias("q"))
    part = F.struct("fold", "n", "m", "q")
    per_dim = wide.groupBy(*by, "d").agg(F.collect_list(part).alias("parts"))
    others = per_dim.withColumn("f", F.explode("parts")).select(
        *by, "d", F.col("f.fold").alias("fold"),
        F.filter("parts", lambda p: p["fold"] != F.col("f.fold")).alias("o"))
    n = F.aggregate("o", F.lit(0.0), lambda s, p: s + p["n"])
    others = others.filter(F.size("o") > 0).withColumn("n", n).withColumn(
        "mean", F.aggregate("o", F.lit(0.0), lambda s, p: s + p["n"] * p["m"]) / F.col("n"))
    others = others.withColumn(
        "var",
        F.aggregate("o", F.lit(0.0), lambda s, p: s + p["q"] + p["n"] * F.pow(p["m"] - F.col("mean"), 2)) / F.col("n"))
    # A constant column must come out as exactly constant, whatever the rounding of its mean.
    sd = F.when(_is_constant(F.col("n"), F.col("mean"), F.col("var")), 0.0).otherwise(F.sqrt("var"))
    return others.groupBy(*by, "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "mean"))), lambda x: x["mean"]).alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("d", sd.alias("sd")))), lambda x: x["sd"]).alias("sd"),
    )


def scaler(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Mean and population SD of all given rows per cell: ``by, mean, sd``."""
    n = F.col("_m.count").cast("double")
    var = F.transform(vector_to_array("_m.variance"), lambda x: x * (n - 1) / n)
    mean = vector_to_array("_m.mean")
    return df.groupBy(*by).agg(vector_moments(v).alias("_m")).select(
        *by, mean.alias("mean"),
        F.zip_with(var, mean, lambda s, m: F.when(
            _is_constant(n, m, s), 0.0).otherwise(F.sqrt(s))).alias("sd"))
