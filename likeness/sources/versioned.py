"""Tables whose versions are published as a whole.

A commit writes its parts into a folder of its own, then publishes one manifest that names the folders of
all parts; the manifest appears by a rename, which either happens or does not. A reader takes the
latest manifest, so a writer that dies at any point leaves the table as it was, and what it wrote is
in no version. Two writers that publish the same version number cannot both succeed.

The lineage check is part of the commit: the rows to be written and every part that stays must carry
the expected environment and configuration hashes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.lineage import LineageError, check_table

PART = "_part"
DIGITS = 12


class ConflictError(RuntimeError):
    """Another writer published this version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first. A listing of manifests, never of data."""
    p, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the latest; None for a table that was never published."""
    known = versions(spark, path)
    if not known:
        return None
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"no version {version} of {path}")
    text = spark.read.text(f"{path}/manifests/{version:0{DIGITS}d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    name = f"{content['version']:0{DIGITS}d}.json"
    temp, fs = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{name}")
    if fs.exists(target) or not fs.rename(temp, target):
        fs.delete(temp, False)
        raise ConflictError(f"{path} has a version {content['version']} of another writer")


def commit(df: DataFrame, path: str, expected: tuple[str, str], key: str | None = None, emptied: list[str] | None = None,
           append: bool = False) -> int:
    """Publish the next version and return its number.

    Without ``key`` the rows replace the whole table. With ``key`` they replace the parts of the keys they
    hold and of those in ``emptied``; other parts stay. ``append`` keeps every earlier part beside the new ones.
    ``expected`` is (environment hash, configuration hash).
    """
    spark = df.sparkSession
    before = manifest(spark, path)
    stays = before and (key is not None or append)
    if stays and before["lineage"] != list(expected):
        raise LineageError(f"{path} was written under {before['lineage']}, expected {list(expected)}")
    version = before["version"] + 1 if before else 1
    folder = f"data/{version:0{DIGITS}d}-{uuid.uuid4().hex}"
    value = F.lit("all") if key is None else F.coalesce(F.hex(F.col(key).cast("string").cast("binary")), F.lit("null"))
    df.withColumn(PART, value).write.partitionBy(PART).parquet(f"{path}/{folder}")
    # From here on only what was written is looked at, so the input is computed once.
    p, fs = _fs(spark, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    new = {n.split("=", 1)[1]: [f"{folder}/{n}"] for n in names if n.startswith(f"{PART}=")}
    written = read_parts(spark, path, [f for fs_ in new.values() for f in fs_], df.schema)
    check_table(written, *expected)
    kept = {}
    if stays:
        gone = {"null" if e is None else str(e).encode().hex().upper() for e in emptied or []}
        kept = {k: v for k, v in before["parts"].items() if append or (k not in new and k not in gone)}
    parts = {k: [*kept.get(k, []), *new.get(k, [])] for k in {**kept, **new}}
    _publish(spark, path, {"version": version, "lineage": list(expected), "schema": json.loads(df.schema.json()), "parts": parts})
    return version


def read_parts(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, by default the latest; None for a table that was never published."""
    from pyspark.sql.types import StructType

    found = manifest(spark, path, version)
    if found is None:
        return None
    return read_parts(spark, path, sorted(f for fs in found["parts"].values() for f in fs), StructType.fromJson(found["schema"]))


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all but the latest ``keep`` versions and the data that only they name, and folders no version names.

    Run it when no writer is at work: the folder of an unpublished commit belongs to no version.
    """
    known = versions(spark, path)
    for old in known[:-keep]:
        p, fs = _fs(spark, f"{path}/manifests/{old:0{DIGITS}d}.json")
        fs.delete(p, False)
    used = {f.split("/")[1] for v in known[-keep:] for fs_ in manifest(spark, path, v)["parts"].values() for f in fs_}
    p, fs = _fs(spark, f"{path}/data")
    for status in fs.listStatus(p) if fs.exists(p) else []:
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
