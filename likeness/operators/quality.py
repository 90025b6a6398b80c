"""Gates on metadata and files. Each returns its findings as a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.session import bounded, durable

BUCKET = 32_768         # bits of one bitmap


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """``n_rows, n_keys, n_duplicates``."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def describe(df: DataFrame, by: list[str], ind: str = "ind", grp: str = "grp", item: str = "item") -> DataFrame:
    """Rows, individuals, groups, least and most items per individual, groups with several individuals.

    Two aggregations of the rows, one by individual and one by group; nothing as long as the input is kept.
    """
    people = df.groupBy(*by, ind).agg(F.countDistinct(item).alias("k"), F.count("*").alias("n"))
    people = people.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_individuals"),
        F.min("k").alias("min_items_per_individual"), F.max("k").alias("max_items_per_individual"))
    groups = shared_groups(df, by, ind, grp).groupBy(*by).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n_individuals") > 1).alias("n_shared_groups"))
    return people.join(groups, by)


def shared_groups(df: DataFrame, by: list[str], ind: str = "ind", grp: str = "grp") -> DataFrame:
    """``by, grp, n_individuals``."""
    return df.groupBy(*by, grp).agg(F.countDistinct(ind).alias("n_individuals"))


def expectation_report(observed: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """``by, check, expected, observed, outcome``: one row per expected figure.

    ``expected`` holds ``by, check, expected, tolerance``; ``observed`` one column per check.
    """
    names = [c for c in observed.columns if c not in by]
    long = observed.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("observed")) for c in names])).alias("o"))
    long = long.select(*by, "o.check", "o.observed")
    ok = F.abs(F.col("observed") - F.col("expected")) <= F.coalesce("tolerance", F.lit(0.0))
    return expected.join(long, [*by, "check"], "left").select(
        *by, "check", "expected", "observed",
        F.when(F.col("observed").isNull(), "not run").when(ok, "pass").otherwise("fail").alias("outcome"))


def null_report(df: DataFrame, column: str, key: str) -> DataFrame:
    """``n_rows, n_missing, first_missing``."""
    bad = F.col(column).isNull()
    return df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_missing"),
                  F.min(F.when(bad, F.col(key))).alias("first_missing"))


def problem_report(status: DataFrame, by: list[str], status_col: str = "status", name: str = "path",
                   ok: str = "ok") -> DataFrame:
    """``by, status, n, first`` for every problem class."""
    return status.filter(F.col(status_col) != ok).groupBy(*by, status_col).agg(
        F.count("*").alias("n"), F.min(name).alias("first"))


def file_status(items: DataFrame, found: DataFrame, checksums: DataFrame | None = None) -> DataFrame:
    """``path, status``: ok, absent, empty, unreadable or changed.

    ``found`` holds ``path, status, md5``; a checksum counts only where one is recorded.
    """
    rows = items.select("path").join(
        found.select("path", F.col("status").alias("_s"), "md5"), "path", "left")
    if checksums is None:
        changed = F.lit(False)
    else:
        rows = rows.join(checksums.select("path", F.col("md5").alias("_rec")), "path", "left")
        changed = F.col("_rec").isNotNull() & (F.col("_rec") != F.col("md5"))
    return rows.select("path", F.when(F.col("_s").isNull(), "absent").when(F.col("_s") != "ok", F.col("_s"))
                       .when(changed, "changed").otherwise("ok").alias("status"))


def dense_ranks(keys: DataFrame, key: str, out: str = "_r") -> DataFrame:
    """``key, out``: 0-based ranks of distinct keys in their order, from range-sorted parts shifted by their sizes."""
    parts = keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    parts = durable(parts.select(key, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_part", (before - F.col("_first")).alias("_shift")))     # one row per partition
    return parts.join(shifts, "_part").select(key, (F.col("_at") + F.col("_shift")).alias(out))


def _first_gaps(n: int):
    """The first ``n`` positions of a bucket that its bitmap lacks."""
    def find(bits: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for b, s in zip(bits, size):
            held = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[:s] if b is not None else np.zeros(s, np.uint8)
            out.append(np.flatnonzero(held == 0)[:n].tolist())
        return pd.Series(out)

    return F.pandas_udf(find, "array<long>")


def completeness(expected: DataFrame, found: DataFrame, models: DataFrame, item: str = "item", n_first: int = 3) -> DataFrame:
    """``model, n_expected, n_found, n_missing, first_missing, status`` per model.

    Expected items get dense ranks; what a model holds is one bitmap per ``BUCKET`` ranks. Counts are bit counts, and
    the first missing items are read from the first buckets that are not full. Items and models never meet.
    """
    ranks = durable(dense_ranks(expected, item))
    sizes = ranks.groupBy(F.floor(F.col("_r") / BUCKET).alias("_bucket")).agg(F.count("*").cast("int").alias("_size"))
    total = ranks.agg(F.count("*").alias("n_expected"))
    place = (F.col("_r") % BUCKET).cast("long")
    held = found.select("model", item).distinct().join(ranks, item).groupBy("model", F.floor(F.col("_r") / BUCKET).alias("_bucket")).agg(
        F.bitmap_construct_agg(place).alias("_bits"))
    held = durable(held.withColumn("_held", F.bitmap_count("_bits")))
    models = models.select("model").distinct()
    counts = models.join(held.groupBy("model").agg(F.sum("_held").alias("_f")), "model", "left").crossJoin(total).select(
        "model", "n_expected", F.coalesce("_f", F.lit(0)).alias("n_found"))
    counts = counts.withColumn("n_missing", F.col("n_expected") - F.col("n_found"))
    # Models that lack something but not everything, times buckets: N / BUCKET rows each, not N.
    partly = counts.where("n_missing > 0 and n_found > 0").select("model").crossJoin(sizes)
    open_ = partly.join(held, ["model", "_bucket"], "left").withColumn("_lack", F.col("_size") - F.coalesce("_held", F.lit(0))).where("_lack > 0")
    before = F.sum("_lack").over(Window.partitionBy("model").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    open_ = open_.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n_first)
    gaps = open_.select("model", "_bucket", F.explode(_first_gaps(n_first)("_bits", "_size")).alias("_p")).select(
        "model", (F.col("_bucket") * BUCKET + F.col("_p")).alias("_r"))
    first = gaps.join(ranks, "_r").groupBy("model").agg(F.slice(F.array_sort(F.collect_list(F.struct("_r", F.col(item).cast("string").alias("i")))), 1, n_first).alias("_l"))
    first = first.select("model", F.array_join(F.sort_array(F.transform("_l", lambda x: x["i"])), ",").alias("first_missing"))
    status = F.when(F.col("n_found") == 0, "none").when(F.col("n_missing") > 0, "incomplete").otherwise("complete")
    return counts.join(first, "model", "left").withColumn("status", status)


def deduplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
