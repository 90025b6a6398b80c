"""Frame-level features: deltas, per-group normalisation, summaries, spectral frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness import settings as S
from likeness.session import bounded, one_thread_per_task


def deltas(frames: DataFrame, by: list[str], value: str = "value", frame: str = "frame", out: str = "delta") -> DataFrame:
    """Local slope along the frames of one item and coefficient.

    Width ``min(9, max(3, (T // 2) * 2 - 1))`` for T frames; the first and last frames take the
    slope of the nearest full window. ``frame`` counts from 0.
    """
    item = Window.partitionBy(*by)
    along = item.orderBy(frame)
    total = F.count("*").over(item)
    half = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(total / 2) - 1))
    d = frames.withColumn("_t", total).withColumn("_h", half.cast("int"))
    slope = None
    for h in (1, 2, 3, 4):
        s = F.regr_slope(F.col(value).cast("double"), F.col(frame).cast("double")).over(along.rowsBetween(-h, h))
        slope = F.when(F.col("_h") == h, s) if slope is None else slope.when(F.col("_h") == h, s)
    full = (F.col(frame) >= F.col("_h")) & (F.col(frame) <= F.col("_t") - 1 - F.col("_h"))
    d = d.withColumn("_s", F.when(full, slope))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.when(F.col(frame) < F.col("_h"), F.first("_s", ignorenulls=True).over(whole)).otherwise(
        F.last("_s", ignorenulls=True).over(whole))
    return d.withColumn(out, F.coalesce("_s", edge)).drop("_t", "_h", "_s")


def group_statistics(frames: DataFrame, grp: list[str], coeff: str = "coeff", value: str = "value") -> DataFrame:
    """Pooled mean and ``sd + 1e-8`` of all frames of all items of a group."""
    return frames.groupBy(*grp, coeff).agg(
        F.avg(value).alias("mean"), (F.stddev_pop(value) + 1e-8).alias("sd"))


def normalise_by_group(frames: DataFrame, grp: list[str], coeff: str = "coeff", value: str = "value",
                       out: str = "normalised") -> DataFrame:
    stats = bounded(group_statistics(frames, grp, coeff, value))
    return frames.join(stats, [*grp, coeff]).withColumn(
        out, (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def summarise(frames: DataFrame, item: list[str], coeff: str = "coeff", value: str = "value") -> DataFrame:
    """One vector per item: means of all coefficients, then their population SDs."""
    per = frames.groupBy(*item, coeff).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct(coeff, "m", "s")))
    return per.groupBy(*item).agg(ordered.alias("c")).select(
        *item, F.concat(F.transform("c", lambda x: x["m"]), F.transform("c", lambda x: x["s"])).alias("v"))


def _mel_filters(rate: int, n_fft: int, n_mels: int, fmin: float, fmax: float) -> np.ndarray:
    """Triangular filters on the Slaney mel scale, each of unit area."""
    def to_mel(f):
        f = np.asarray(f, float)
        return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))

    def to_hz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))

    edges = to_hz(np.linspace(to_mel(fmin), to_mel(fmax), n_mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def _cepstra(samples: np.ndarray, rate: int, n_mfcc: int) -> np.ndarray:
    """(frames, coefficients) of one clip: power mel spectrogram, 80 dB floor, orthonormal DCT-II."""
    n_fft, hop = int(rate * S.WINDOW_SECONDS), int(rate * S.HOP_SECONDS)
    if len(samples) < 2 * n_fft:
        samples = np.pad(samples, (0, 2 * n_fft - len(samples)))
    padded = np.pad(samples, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
    mel = power @ _mel_filters(rate, n_fft, S.N_MELS, S.FMIN_HZ, S.FMAX_HZ).T
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max() - 80.0)
    k, n = np.arange(n_mfcc)[:, None], np.arange(S.N_MELS)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * S.N_MELS)) * np.sqrt(2.0 / S.N_MELS)
    basis[0] /= np.sqrt(2.0)
    return db @ basis.T


def spectral_frames(clips: DataFrame, keys: list[str], n_mfcc: int, samples: str = "samples",
                    rate: int = S.SAMPLE_RATE, rate_column: str | None = None) -> DataFrame:
    """``keys, frame, coeff, value``: one clip per row in, one row per frame and coefficient out.

    ``rate_column`` tells each clip's own rate: another one than ``rate`` stops the job.
    """
    if rate_column:
        fault = F.raise_error(F.format_string(f"expected {rate} samples a second, found %d", F.col(rate_column)))
        whole = F.when(F.col(rate_column) == rate, F.col(samples)).otherwise(fault.cast(clips.schema[samples].dataType))
        clips = clips.withColumn(samples, whole)
    schema = T.StructType([clips.schema[c] for c in keys] + [
        T.StructField("frame", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            names = [f.name for f in batch.schema]
            for i in range(batch.num_rows):
                clip = np.asarray(batch.column(names.index(samples))[i].values, dtype=float)
                c = _cepstra(clip, rate, n_mfcc)
                cols = [[batch.column(names.index(k))[i].as_py()] * len(c) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, type=batch.schema.field(k).type) for col, k in zip(cols, keys)]
                    + [pa.array(range(len(c)), pa.int32()), pa.array(list(c), pa.list_(pa.float64()))],
                    names=[*keys, "frame", "values"])

    one_thread_per_task(clips)
    found = clips.select(*keys, samples).mapInArrow(run, schema)
    return found.select(*keys, "frame", F.posexplode("values").alias("coeff", "value"))


def spectral_vectors(clips: DataFrame, keys: list[str], grp: str, variant: str, **options) -> DataFrame:
    """Summary vectors of one registered variant: ``keys, grp, model, v``."""
    how = S.MFCC_VARIANTS[variant]
    frames = spectral_frames(clips, [*keys, grp], how["n_mfcc"], **options)
    if how["deltas"]:
        slopes = deltas(frames, [*keys, grp, "coeff"])
        both = F.explode(F.array(
            F.struct(F.col("coeff"), F.col("value")),
            F.struct((F.col("coeff") + how["n_mfcc"]).alias("coeff"), F.col("delta").alias("value"))))
        frames = slopes.withColumn("_b", both).select(*keys, grp, "frame", "_b.coeff", "_b.value")
    if how["cmvn"]:
        frames = normalise_by_group(frames, [grp], out="_z").withColumn("value", F.col("_z"))
    return summarise(frames, [*keys, grp]).withColumn("model", F.lit(variant))
