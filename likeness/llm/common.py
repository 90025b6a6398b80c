"""What several operators share: stored hand-over, components, word hashes over Arrow buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.session import checkpoint_dir

SPACE = np.uint8(32)
BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
SLICE_BYTES = 1 << 18
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound the bytes that reach a Python worker at once; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it again.

    The lineage is cut, lost executors lose nothing, and later passes read only the columns they use.
    Shuffle files of the writing job go when it ends; the written table stands in for them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column | str) -> Column:
    """16 bytes that stand for a whole text; a null text counts as the empty one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Components -----------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the least node reachable.

    Alternating large-star and small-star steps; each is one aggregation with partial minima and
    one join. Stops when only stars are left: no node has two edges up, or one up and one down.
    Self-loops are ignored.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _only_stars(edges):
        edges = stored(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()


def _only_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())


# Words ----------------------------------------------------------------------------------------
def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as far as a text needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._run(x, n) for x in (BASE, pow(BASE, -1, 2**64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)


POWERS = Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, and where each row's words begin among them.

    ``data`` holds the rows' bytes with separators already turned into spaces; ``bounds`` are the
    row offsets, from 0.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = data != SPACE
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = word & edge[:n]
    first[1:] |= word[1:] & ~word[:-1]
    last = word & edge[1:]
    last[:-1] |= word[:-1] & ~word[1:]
    first[0] = word[0]
    last[-1] = word[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, bounds)


def translation(separator) -> np.ndarray:
    """Byte table: A-Z lowered, bytes for which ``separator`` holds turned into spaces."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for i in range(256):
        if separator(int(out[i])):
            out[i] = SPACE
    return out
