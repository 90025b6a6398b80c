"""Metadata tables and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.text import missing_to_null
from likeness.settings import MODEL_PANEL


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with every column as text and every missing token as null."""
    table = spark.read.csv(path, header=True, inferSchema=False, nullValue=None, emptyValue="",
                           quote='"', escape='"', multiLine=True)
    return table.select(*[missing_to_null(f"`{c}`").alias(c) for c in table.columns])


def read_combined(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The union of several master tables; None when one is absent."""
    tables = []
    for path in paths:
        if not path_exists(spark, path):
            return None
        tables.append(read_master(spark, path))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``path, bytes, md5``; an empty table when the file is absent."""
    schema = "path STRING, bytes STRING, md5 STRING"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path)


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON record, one row per file."""
    return spark.read.json(path, multiLine=True)


RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("env_hash", T.MapType(T.StringType(), T.StringType())),
    T.StructField("config_hash", T.StringType()),
    T.StructField("git_commit", T.StringType()),
    T.StructField("dataset_path", T.StringType()),
    T.StructField("stages", T.StringType()),
    T.StructField("allow_env_drift", T.BooleanType()),
])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def model_panel(spark: SparkSession) -> DataFrame:
    """The registered models; a fixed table of 18 rows, so it may be broadcast."""
    schema = "model STRING, family STRING"
    return F.broadcast(spark.createDataFrame(MODEL_PANEL, schema))


def restrict_to_panel(df: DataFrame, names: list[str], panel: DataFrame) -> DataFrame:
    """Keep the named models; an unknown name is an error."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "model STRING")
    unknown = [r.model for r in wanted.join(panel, "model", "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown model(s): {', '.join(sorted(unknown))}")
    return df.filter(F.col("model").isin(names))


def subset(df: DataFrame, rule: dict | None) -> DataFrame:
    """None keeps all rows; ``{column: value}`` keeps the rows with that value."""
    if rule is None:
        return df
    (column, value), = rule.items()
    return df.filter(F.col(column) == value)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a table partitioned by model, in model order."""
    return spark.read.parquet(path).orderBy("model")
