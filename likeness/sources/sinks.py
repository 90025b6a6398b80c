"""Writers. Every sink is one distributed write; a table's schema is its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.lineage import check_table
from likeness.sources.tables import RUN_SCHEMA, path_exists


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", expected: tuple[str, str] | None = None) -> None:
    """Append. With ``expected`` (env hash, config hash), rows of another lineage in the table stop it."""
    if expected and path_exists(df.sparkSession, path):
        check_table(df.sparkSession.read.format(fmt).options(header=True).load(path), *expected)
    df.write.mode("append").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def replace_table(df: DataFrame, path: str, expected: tuple[str, str]) -> None:
    """Overwrite a table of the same lineage; rows of another one, on either side, stop it."""
    check_table(df, *expected)
    if path_exists(df.sparkSession, path):
        check_table(df.sparkSession.read.parquet(path), *expected)
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature vectors, laid out so that a read of one dataset or model touches only its folder."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "model").parquet(path)


def wide_vectors(df: DataFrame, dim: int, v: str = "v", keep: list[str] | None = None) -> DataFrame:
    """``keep, e0 .. e{dim-1}``; a vector of another length stops the job, a null one gives nulls."""
    keep = keep or [c for c in df.columns if c != v]
    fault = F.raise_error(F.concat(F.lit(f"expected {dim} components, found "), F.size(v).cast("string")))
    whole = F.when(F.col(v).isNull() | (F.size(v) == dim), F.col(v)).otherwise(fault.cast(df.schema[v].dataType))
    return df.select(*keep, *[F.get(whole, F.lit(i)).alias(f"e{i}") for i in range(dim)])


def long_predictions(preds: DataFrame, **constants) -> DataFrame:
    """Predictions with constant identifying columns."""
    return preds.withColumns({k: F.lit(v) for k, v in constants.items()})


def start_run(spark: SparkSession, path: str, run_id: str, env_hash: dict, config_hash: str, stages: str,
              git_commit: str | None = None, dataset_path: str | None = None, allow_env_drift: bool = False) -> DataFrame:
    """Append the record of a run and return it."""
    row = [(run_id, env_hash, config_hash, git_commit, dataset_path, stages, allow_env_drift)]
    record = spark.createDataFrame(row, RUN_SCHEMA)
    record.coalesce(1).write.mode("append").json(path)
    return record


def write_provenance(spark: SparkSession, path: str, feature_set: str, run_id: str, env_hash: str, config_hash: str) -> None:
    """One row per feature set."""
    spark.createDataFrame(
        [(feature_set, run_id, env_hash, config_hash)],
        "feature_set STRING, run_id STRING, env_hash STRING, config_hash STRING",
    ).coalesce(1).write.mode("append").json(path)
