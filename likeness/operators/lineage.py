"""Which run, environment and configuration produced a row; digests and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import package_name, row_md5
from likeness.settings import STAMP_COLUMNS


class LineageError(ValueError):
    """Rows of different environments or configurations were about to meet."""


def stamp(df: DataFrame, run_id: str, env_hash: str, config_hash: str) -> DataFrame:
    return df.withColumns(dict(zip(STAMP_COLUMNS, map(F.lit, (run_id, env_hash, config_hash)))))


def foreign_rows(df: DataFrame, env_hash: str, config_hash: str) -> DataFrame:
    """Rows that were not written under the expected hashes."""
    return df.filter(~(F.col("env_hash").eqNullSafe(env_hash) & F.col("config_hash").eqNullSafe(config_hash)))


def check_table(df: DataFrame, env_hash: str, config_hash: str) -> None:
    """Stop when a table to be extended holds rows of another lineage, or none at all."""
    missing = [c for c in STAMP_COLUMNS if c not in df.columns]
    if missing:
        raise LineageError(f"the table carries no {', '.join(missing)}, so its origin cannot be checked")
    bad = foreign_rows(df, env_hash, config_hash).select("env_hash", "config_hash").limit(1).collect()
    if bad:
        raise LineageError(
            f"written under env {bad[0].env_hash} / config {bad[0].config_hash}, "
            f"expected env {env_hash} / config {config_hash}")


def feature_agreement(provenance: DataFrame, by: list[str]) -> DataFrame:
    """``by, n_sets, n_lineages, agree``: do all feature sets share one environment and configuration?"""
    key = F.struct("env_hash", "config_hash")
    return provenance.groupBy(*by).agg(
        F.count("*").alias("n_sets"), F.countDistinct(key).alias("n_lineages"),
        F.count_if(F.col("env_hash").isNull() | F.col("config_hash").isNull()).alias("n_unstamped"),
    ).withColumn("agree", (F.col("n_lineages") == 1) & (F.col("n_unstamped") == 0))


def check_features(provenance: DataFrame, extraction_hash: str | None = None) -> str:
    """The environment hash on which all feature sets agree."""
    seen = provenance.select("env_hash", "config_hash").distinct().limit(3).collect()
    if len(seen) != 1 or seen[0].env_hash is None or seen[0].config_hash is None:
        raise LineageError(f"feature sets disagree or are unstamped: {[tuple(r) for r in seen]}")
    if extraction_hash and seen[0].env_hash != extraction_hash:
        raise LineageError(f"features come from {seen[0].env_hash}, the run records {extraction_hash}")
    return seen[0].env_hash


def content_digest(df: DataFrame, by: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """``by, n_rows, digest``: equal for equal bags of rows, whatever their order.

    Row digests are added up, so tasks combine partial sums and no sort is needed. Stamp columns
    do not count.
    """
    by = by or []
    skip = set(ignore if ignore is not None else STAMP_COLUMNS) | set(by)
    cols = sorted(c for c in df.columns if c not in skip)
    h = row_md5(*cols)

    def part(start: int):
        return F.sum(F.conv(F.substring(h, start, 15), 16, 10).cast("decimal(38,0)"))

    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), part(1).alias("_a"), part(16).alias("_b"),
    ).select(*by, "n_rows", F.md5(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("_a").cast("string"),
                                              F.col("_b").cast("string"))).alias("digest"))


def package_digest(packages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of the sorted ``name==version`` lines of an environment (some hundred lines)."""
    by = by or []
    line = F.concat(package_name("name"), F.lit("=="), F.col("version"))
    return packages.groupBy(*by).agg(
        F.md5(F.array_join(F.sort_array(F.collect_set(line)), "\n")).alias("env_hash"))


def merkle_digest(df: DataFrame, line, by: list[str] | None = None, prefix: int = 3) -> DataFrame:
    """``by, n_lines, digest`` of distinct lines, the same for every order and partitioning.

    Lines are sliced by the first ``prefix`` digits of their md5. A slice digests its sorted lines, the root digests the
    sorted ``slice=digest`` pairs, of which there are at most ``16**prefix``: no task holds more than a slice.
    """
    by = by or []
    lines = df.select(*by, line.alias("_line")).where("_line is not null").distinct()
    lines = lines.withColumn("_h", F.md5("_line")).withColumn("_slice", F.left("_h", F.lit(prefix)))
    leaves = lines.groupBy(*by, "_slice").agg(F.md5(F.array_join(F.sort_array(F.collect_list("_h")), "")).alias("_d"), F.count("*").alias("_n"))
    pairs = F.sort_array(F.collect_list(F.concat("_slice", F.lit("="), "_d")))
    return leaves.groupBy(*by).agg(F.sum("_n").alias("n_lines"), F.md5(F.array_join(pairs, "\n")).alias("digest"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``path, n_rows, md5_content`` of result tables."""
    out = None
    for name, df in tables.items():
        one = content_digest(df).select(F.lit(name).alias("path"), "n_rows", F.col("digest").alias("md5_content"))
        out = one if out is None else out.unionByName(one)
    return out
