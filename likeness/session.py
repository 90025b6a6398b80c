"""Session defaults, size-checked broadcast and durable hand-over between stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 200_000
MAX_SMALL_BYTES = 64 << 20


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "likeness") -> SparkSession:
    """A single-machine session for tests and measurements; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.default.parallelism", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_thread_per_task(df: DataFrame) -> None:
    """Spark already runs one task per core: keep NumPy in those tasks from starting threads of its own."""
    env = df.sparkSession.sparkContext.environment
    for name in ("OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "OMP_NUM_THREADS"):
        env.setdefault(name, "1")


def small_table(df: DataFrame, max_rows: int = MAX_SMALL_ROWS, max_bytes: int = MAX_SMALL_BYTES):
    """The rows of ``df`` as an Arrow table, or None when they exceed the bound.

    The limit runs in the tasks: an oversized frame sends ``max_rows + 1`` rows, never all of them.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return table


def bounded(df: DataFrame, max_rows: int = MAX_SMALL_ROWS, max_bytes: int = MAX_SMALL_BYTES,
            source: DataFrame | None = None) -> DataFrame:
    """``df`` computed once and marked for broadcast if it is provably small, else unchanged.

    Unchanged frames are joined by a shuffle, where adaptive execution splits skewed keys. When
    ``df`` aggregates a ``source`` that was found small before, it is small without a new check.
    """
    if source is not None and is_small(source):
        return _mark(F.broadcast(df))
    table = small_table(df, max_rows, max_bytes)
    if table is None:
        return df
    return _mark(F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema)))


def _mark(df: DataFrame) -> DataFrame:
    df._proven_small = True
    return df


def is_small(df: DataFrame) -> bool:
    """Did ``bounded`` prove this very frame small?"""
    return "_proven_small" in df.__dict__


def spread(df: DataFrame, keys: list[str], units: int = 0, most: int = 100_000) -> DataFrame:
    """Hash ``df`` on ``keys`` over a fixed number of tasks.

    Adaptive execution merges shuffle partitions by their bytes. Work that costs far more per
    byte (a model fit, a product of two blocks) would end up in one task, so its parallelism is
    stated: the number of work units, at least four per core.
    """
    spark = df.sparkSession
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(max(least, units), most), *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there: survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
