"""Vector files, audio files and file inventories, read as distributed binary scans."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.text import item_from_file, model_from_dir
from likeness.functions.vectors import is_finite
from likeness.operators.lineage import merkle_digest
from likeness.session import bounded


def scan(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """``path, modificationTime, length, content``; content is only read when selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(path)


def inventory(spark: SparkSession, path: str | list[str], glob: str, min_bytes: int = 0) -> DataFrame:
    """``path, bytes, md5, sha256`` of matching files."""
    return scan(spark, path, glob).filter(F.col("length") >= min_bytes).select(
        "path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``n_files, bytes, md5_files`` of a folder: one row, the same for every order of its files.

    Names do not count, so a table written again with equal files keeps its digest. Equal files are told
    apart by how often they occur; no file at all gives the md5 of nothing.
    """
    found = inventory(spark, path, glob).groupBy("md5").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sums = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    digest = merkle_digest(found, F.concat_ws("|", "md5", F.col("n").cast("string"))).select(F.col("digest").alias("md5_files"))
    return sums.crossJoin(digest)       # one row each


def model_dirs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``model, dir``: directories named ``<stamp>___<model>-<dataset>`` that hold vectors.

    A model found under several roots belongs to the last of them.
    """
    found = None
    for order, root in enumerate(roots):
        files = scan(spark, root, "*.npy").select("path")
        one = files.select(
            model_from_dir("path").alias("model"), F.lit(order).alias("_o"),
            F.regexp_extract("path", r"^(.*?/[^/]*___[^/]*-[^-/]+)/", 1).alias("dir"))
        found = one if found is None else found.unionByName(one)
    return found.filter(F.col("model") != "").groupBy("model").agg(
        F.max_by("dir", F.struct("_o", "dir")).alias("dir"))


DECODED_ROWS = 4096
VECTOR_SCHEMA = "path string, window int, v array<float>, error string"


def _decode(batches):
    """One batch of rows per file, and several for a long one: no list grows with the number of files."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            path = path.as_py()
            try:
                m = np.atleast_2d(np.load(io.BytesIO(content.as_buffer()), allow_pickle=False))
                if m.ndim != 2:
                    raise ValueError(f"expected a matrix, found {m.ndim} dimensions")
                m = m.astype("float32")
            except Exception as e:  # an unreadable file is reported, not fatal
                error = str(e) if str(e).startswith("expected a matrix") else f"{type(e).__name__}: {e}"
                yield _vector_batch([path], [None], pa.nulls(1, pa.list_(pa.float32())), [error])
                continue
            for start in range(0, len(m), DECODED_ROWS):
                part = m[start:start + DECODED_ROWS]
                ends = np.arange(len(part) + 1, dtype="int32") * m.shape[1]
                v = pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))
                yield _vector_batch([path] * len(part), range(start, start + len(part)), v, [None] * len(part))


def _vector_batch(path, window, v, error):
    return pa.RecordBatch.from_arrays(
        [pa.array(path, pa.string()), pa.array(window, pa.int32()), v, pa.array(error, pa.string())],
        names=["path", "window", "v", "error"])


def read_vectors(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``model, item, window, v, single, error``: one row per window of every vector file.

    Files that do not load come back with ``error`` set. ``single`` tells whether the file lies
    under a ``/single/`` folder.
    """
    dirs = bounded(model_dirs(spark, roots))
    files = scan(spark, roots, "*.npy").select("path", "content").withColumn("model", model_from_dir("path"))
    owner = F.regexp_extract("path", r"^(.*?/[^/]*___[^/]*-[^-/]+)/", 1)
    files = files.withColumn("dir", owner).join(dirs, ["model", "dir"], "left_semi")
    rows = files.select("path", "content").mapInArrow(_decode, VECTOR_SCHEMA)
    rows = rows.withColumn("model", model_from_dir("path"))
    return rows.select(
        "model", item_from_file("path", F.col("model")).alias("item"), "window", "v",
        F.col("path").contains("/single/").alias("single"), "error").filter(F.col("item").isNotNull())


def single_items(vectors: DataFrame) -> DataFrame:
    """Items that any model stored as single."""
    return vectors.filter("single").select("item").distinct()


def identity_frame(vectors: DataFrame, master: DataFrame, grain: str = "window") -> DataFrame:
    """Vectors joined to their metadata in the canonical layout.

    Identity and group come from the metadata, never from file names. Items without a group are
    dropped. Non-finite vectors drop a window (``grain="window"``) or the whole item ("item").
    """
    items = master.select(
        F.col("original_stem").alias("item"), F.lower("bird").alias("ind"), F.col("recording_id").alias("grp"),
        F.col("kind").alias("_kind"), F.col("call_type").alias("stratum"), F.col("sibling_group").alias("family"),
        "environment_class",
    ).filter(F.col("grp").isNotNull())
    good = vectors.filter(F.col("error").isNull()).withColumn("_ok", is_finite("v"))
    if grain == "window":
        good = good.filter("_ok")
    elif grain == "item":
        whole = good.groupBy("model", "item").agg(F.every("_ok").alias("_all")).filter("_all")
        good = good.join(whole.select("model", "item"), ["model", "item"], "left_semi")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    singles = single_items(vectors).withColumn("_single", F.lit(True))
    return (
        good.drop("_ok", "error", "single").join(bounded(items), "item").join(bounded(singles), "item", "left")
        .withColumn("kind", F.when(F.col("_single"), "single").otherwise(F.coalesce("_kind", F.lit("repeated"))))
        .withColumn("v", F.col("v").cast("array<double>"))
        .drop("_single", "_kind")
    )


# Audio ----------------------------------------------------------------------------------------
def _chunks(content: bytes) -> dict:
    """Offsets of the format and data chunks of a RIFF/WAVE file."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    found, at = {}, 12
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4:at + 8], "little")
        found.setdefault(content[at:at + 4], (at + 8, min(size, len(content) - at - 8)))
        at += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("no format or data chunk")
    return found


def _header(content: bytes) -> tuple:
    """(tag, channels, rate, bits, data offset, data bytes)."""
    c = _chunks(content)
    at, _ = c[b"fmt "]
    tag, channels, rate, _, _, bits = np.frombuffer(content[at:at + 16], "<u2,<u2,<u4,<u4,<u2,<u2")[0]
    if tag == 0xFFFE:
        tag = int.from_bytes(content[at + 24:at + 26], "little")
    return int(tag), int(channels), int(rate), int(bits), *c[b"data"]


def _samples(content: bytes) -> np.ndarray:
    """(channels, frames) in [-1, 1)."""
    tag, channels, _, bits, at, size = _header(content)
    width = bits // 8
    data = content[at:at + size - size % (width * channels)]
    if tag == 3:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 8:
        x = (np.frombuffer(data, "u1").astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data, "u1").reshape(-1, 3).astype("int32")
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    elif bits in (16, 32):
        x = np.frombuffer(data, f"<i{width}").astype(float) / float(1 << (bits - 1))
    else:
        raise ValueError(f"{bits}-bit samples are not supported")
    return x.reshape(-1, channels).T


def _pad(content: bytes, min_seconds: float) -> tuple[bytes, int]:
    """Append silence up to ``round(min_seconds * rate)`` frames; the samples are not re-coded."""
    _, channels, rate, bits, at, size = _header(content)
    frame = channels * bits // 8
    need = int(round(min_seconds * rate)) - size // frame
    if need <= 0:
        return content, 0
    silence = (b"\x80" if bits == 8 else b"\x00") * (need * frame)
    new = size + len(silence)
    end = at + size + size % 2
    out = content[:at - 4] + new.to_bytes(4, "little") + content[at:at + size] + silence + b"\x00" * (new % 2) + content[end:]
    return out[:4] + (len(out) - 8).to_bytes(4, "little") + out[8:], need


def audio_status(files: DataFrame) -> DataFrame:
    """``path, status, frames, reason`` with status ok / empty / unreadable for a ``scan``."""
    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    _, channels, _, bits, _, size = _header(content)
                    frames = size // (channels * bits // 8)
                    out.append((path, "ok" if frames else "empty", frames, None if frames else "no frames"))
                except Exception as e:
                    out.append((path, "unreadable", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "status", "frames", "reason"]).astype({"frames": "Int64"})

    schema = "path string, status string, frames long, reason string"
    read = files.select("path", "content").mapInPandas(run, schema)
    # A scan yields no row for a file of zero bytes; the file listing still names it.
    one_slash = F.regexp_replace("path", "^file:/+", "file:/").alias("path")
    listed = files.sparkSession.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(one_slash)
    zero = listed.join(files.select("path"), "path", "left_anti").select(
        "path", F.lit("empty").alias("status"), F.lit(0).cast("long").alias("frames"), F.lit("zero bytes").alias("reason"))
    return read.unionByName(zero)


def read_audio(files: DataFrame) -> DataFrame:
    """``path, rate, channels ARRAY<ARRAY<DOUBLE>>, error``; a file that cannot be read has only its error."""
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    row = (path, _header(content)[2], list(_samples(content)), None)
                except Exception as e:
                    row = (path, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "rate", "channels", "error"]).astype({"rate": "Int32"})

    return files.select("path", "content").mapInPandas(
        run, "path string, rate int, channels array<array<double>>, error string")


def pad_audio(files: DataFrame, min_seconds: float) -> DataFrame:
    """``path, content, added, error``: format and sample width are kept; long files are byte-identical.

    A file that cannot be read comes back without content and with its error.
    """
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    row = (path, *_pad(content, min_seconds), None)
                except Exception as e:
                    row = (path, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "content", "added", "error"]).astype({"added": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, content binary, added long, error string")


def pad_outcome(items: DataFrame, sources: DataFrame, present: DataFrame, padded: DataFrame) -> DataFrame:
    """``dataset, padded, copied, present, missing`` counts for ``items(dataset, path)``."""
    state = (
        items.join(sources.select("path").distinct().withColumn("_src", F.lit(True)), "path", "left")
        .join(present.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left")
        .join(padded.select("path", "added"), "path", "left")
    )
    here, src, added = F.col("_here").isNotNull(), F.col("_src").isNotNull(), F.col("added") > 0
    return state.groupBy("dataset").agg(
        F.count_if(~here & src & added).alias("padded"),
        F.count_if(~here & src & ~F.coalesce(added, F.lit(False))).alias("copied"),
        F.count_if(here).alias("present"), F.count_if(~here & ~src).alias("missing"))


def first_hit(items: DataFrame, *candidates: DataFrame, key: str = "path") -> DataFrame:
    """Resolve each key in the first candidate table (``key, location``) that knows it."""
    out, names = items, []
    for i, c in enumerate(candidates):
        out = out.join(c.select(key, F.col("location").alias(f"_l{i}")), key, "left")
        names.append(f"_l{i}")
    return out.withColumn("location", F.coalesce(*names)).drop(*names)


def clips_with_audio(master: DataFrame, audio: DataFrame) -> DataFrame:
    """Single items joined to their audio; an absent file is an error."""
    single = master.filter(F.col("kind") == "single")
    absent = single.join(audio, single["rel_audio_path"] == audio["path"], "left_anti").count()
    if absent:
        raise ValueError(f"{absent} item(s) have no audio")
    return single.join(audio, single["rel_audio_path"] == audio["path"]).select(
        F.col("original_stem").alias("item"), F.col("recording_id").alias("grp"), *audio.columns)
