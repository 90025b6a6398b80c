"""Scores from confusion counts, score histograms and contingency counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from likeness.session import bounded, one_thread_per_task, spread


# Classification -------------------------------------------------------------------------------
def confusion(preds: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    return preds.groupBy(*by, truth, pred).agg(F.count("*").alias("n"))


def accuracy(preds: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred",
             out: str = "accuracy") -> DataFrame:
    return preds.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias(out))


def class_counts(preds: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``by, cls, tp, fn, fp`` over the classes seen as truth or prediction."""
    n, hit = F.col("n"), F.col(truth) == F.col(pred)
    zero = F.lit(0).cast("long")
    as_truth = F.struct(F.col(truth).alias("cls"), F.when(hit, n).otherwise(zero).alias("tp"),
                        F.when(~hit, n).otherwise(zero).alias("fn"), zero.alias("fp"))
    as_pred = F.struct(F.col(pred).alias("cls"), zero.alias("tp"), zero.alias("fn"),
                       F.when(~hit, n).otherwise(zero).alias("fp"))
    return (
        confusion(preds, by, truth, pred).withColumn("c", F.explode(F.array(as_truth, as_pred)))
        .groupBy(*by, "c.cls").agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fn", "fp")])
    )


def classification_scores(preds: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``by, n, accuracy, macro_f1, balanced_accuracy`` from one confusion count."""
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    f1 = 2 * tp / (2 * tp + fn + fp)
    recall = F.when(tp + fn > 0, tp / (tp + fn))
    return class_counts(preds, by, truth, pred).groupBy(*by).agg(
        F.sum(tp + fn).alias("n"),
        (F.sum(tp) / F.sum(tp + fn)).alias("accuracy"),
        F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"),
        F.avg(recall).alias("balanced_accuracy"),
    )


def over_folds(per_fold: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean and population SD of each column; NaN counts as absent."""
    aggs = []
    for c in cols:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(x).alias(c), F.stddev_pop(x).alias(f"{c}_sd")]
    return per_fold.groupBy(*by).agg(*aggs, F.count("*").alias("n_folds"))


def vote(preds: DataFrame, by: list[str], order: list[str], item: str = "item",
         truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Majority prediction per item; a tie goes to the label seen first in ``order``."""
    votes = preds.groupBy(*by, item, pred).agg(
        F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"), F.max(truth).alias(truth))
    return votes.groupBy(*by, item).agg(
        F.max(truth).alias(truth), F.min_by(pred, F.struct(-F.col("_n"), "_first", pred)).alias(pred))


def lift(df: DataFrame, accuracy_col: str, n_col: str) -> DataFrame:
    """Add ``chance`` = 1/n and ``lift_over_chance``."""
    return df.withColumn("chance", 1.0 / F.col(n_col)).withColumn(
        "lift_over_chance", F.col(accuracy_col) / F.col("chance"))


# Verification ---------------------------------------------------------------------------------
def auc_eer(hist: DataFrame, by: list[str]) -> DataFrame:
    """``by, n_pos, n_neg, auc, eer``: ROC AUC (ties count one half) and equal error rate.

    The equal error rate is the false positive rate at the ROC vertex with the least
    |false negative - false positive|. Collinear vertices are dropped first and the origin is
    added after that; a tie goes to the highest threshold. Both are null when one side is empty.
    A cell's histogram is bounded (see ``pair_histogram``), so one task can walk it.
    """
    schema = T.StructType([hist.schema[c] for c in by] + [
        T.StructField("n_pos", T.LongType()), T.StructField("n_neg", T.LongType()),
        T.StructField("auc", T.DoubleType()), T.StructField("eer", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        down = np.argsort(-np.asarray(table["bin"]))
        pos, neg = np.asarray(table["pos"])[down], np.asarray(table["neg"])[down]
        tp, fp = np.cumsum(pos), np.cumsum(neg)
        p, n = int(tp[-1]), int(fp[-1])
        auc = eer = None
        if p and n:
            auc = float((pos * (n - fp + neg / 2.0)).sum() / (float(p) * n))
            bend = np.ones(len(pos), bool)
            bend[1:-1] = (pos[1:-1] != pos[2:]) | (neg[1:-1] != neg[2:])
            fpr = np.concatenate([[0.0], fp[bend] / n])
            tpr = np.concatenate([[0.0], tp[bend] / p])
            eer = float(fpr[np.argmin(np.abs((1 - tpr) - fpr))])
        cells = {c: [k.as_py()] for c, k in zip(by, key)}
        return pa.table({**cells, "n_pos": [p], "n_neg": [n], "auc": [auc], "eer": [eer]}, schema=arrow_schema)

    return hist.select(*by, "bin", "pos", "neg").groupBy(*by).applyInArrow(walk, schema)


# Clustering -----------------------------------------------------------------------------------
TERMS = 1 << 20         # hypergeometric terms held at once


def contingency(df: DataFrame, by: list[str], truth: str, cluster: str) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("a"), F.col(cluster).alias("b")).agg(F.count("*").alias("n"))


def _expected_information(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """Mean of (x/n)·ln(n·x/(a·b)) for hypergeometric x, per row.

    Probabilities are built outward from the mode by their ratio, so no factorial of a large
    number is needed, and stop where they no longer change the sum. The terms of many rows lie end to end
    in one array, a bounded number at a time.
    """
    a, b, n = (c.to_numpy(float) for c in (a, b, n))
    lo, hi = np.maximum(0.0, a + b - n), np.minimum(a, b)
    mode = np.clip(np.floor((a + 1) * (b + 1) / (n + 2)), lo, hi)
    sd = np.sqrt(np.maximum(a * b * (n - a) * (n - b) / (n * n * np.maximum(n - 1, 1.0)), 0.0))
    reach = np.ceil(14 * sd) + 60
    lo, hi = np.maximum(lo, mode - reach), np.minimum(hi, mode + reach)
    terms = (hi - lo + 1).astype("int64")
    out = np.zeros(len(a))
    cuts = np.searchsorted(np.cumsum(terms), np.arange(0, terms.sum() + TERMS, TERMS)) if len(a) else []
    for first, last in zip(cuts, [*cuts[1:], len(a)]):
        if first < last:
            r = slice(first, last)
            out[r] = _information_terms(a[r], b[r], n[r], lo[r], mode[r], terms[r])
    return pd.Series(out)


def _information_terms(a, b, n, lo, mode, terms):
    start = np.cumsum(terms) - terms
    row = np.repeat(np.arange(len(a)), terms)
    a, b, n = a[row], b[row], n[row]
    x = lo[row] + (np.arange(len(row)) - start[row])
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.log((a - x + 1) * (b - x + 1)) - np.log(x * (n - a - b + x))
    step[start] = 0.0
    log_w = np.cumsum(step)
    log_w -= log_w[start + (mode - lo).astype("int64")][row]
    w = np.exp(log_w)
    x1 = np.where(x > 0, x, 1.0)
    f = np.where(x > 0, x / n * (np.log(n) + np.log(x1) - np.log(a) - np.log(b)), 0.0)
    return np.add.reduceat(w * f, start) / np.add.reduceat(w, start)


def cluster_scores(cont: DataFrame, by: list[str]) -> DataFrame:
    """Adjusted Rand index, normalised and adjusted mutual information (arithmetic mean).

    Expected information depends on marginal sizes only, so equal sizes are merged before the two
    margins meet: the product of distinct sizes, not of labels.
    """
    one_thread_per_task(cont)
    cont = cont.withColumn("n", F.col("n").cast("double"))
    a = cont.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    b = cont.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = bounded(cont.groupBy(*by).agg(F.sum("n").alias("total")))

    def entropy(m: DataFrame, c: str, out: str, k: str, sq: str) -> DataFrame:
        p = F.col(c) / F.col("total")
        return m.join(total, by).groupBy(*by).agg(
            F.sum(-p * F.ln(p)).alias(out), F.count("*").alias(k), F.sum(F.col(c) * F.col(c)).alias(sq))

    mi = (
        cont.join(bounded(a), [*by, "a"]).join(bounded(b), [*by, "b"]).join(total, by)
        .groupBy(*by).agg(
            F.sum(F.col("n") / F.col("total") * (F.ln("n") + F.ln("total") - F.ln("na") - F.ln("nb"))).alias("mi"),
            F.sum(F.col("n") * F.col("n")).alias("s2"), F.max("total").alias("total"))
    )
    sizes_a = a.groupBy(*by, "na").agg(F.count("*").alias("ca"))
    sizes_b = bounded(b.groupBy(*by, "nb").agg(F.count("*").alias("cb")))
    expected = F.pandas_udf(_expected_information, "double")
    pairs = sizes_a.join(sizes_b, by).join(total, by)
    # Work follows the number of terms, not of bytes: pairs are dealt evenly over a stated number of tasks.
    emi = (
        spread(pairs, ["na", "nb"])
        .groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb") * expected("na", "nb", "total")).alias("emi"))
    )
    d = (
        mi.join(entropy(a, "na", "ha", "ka", "sa"), by).join(entropy(b, "nb", "hb", "kb", "sb"), by).join(emi, by)
    )
    n, s2, sa, sb = (F.col(c) for c in ("total", "s2", "sa", "sb"))
    tp = s2 - n                       # ordered pairs together in both
    fp = sb - s2
    fn = sa - s2
    tn = n * n - fp - fn - s2
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(
        2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    trivial = (F.col("ka") == 1) & (F.col("kb") == 1)
    mean_h = (F.col("ha") + F.col("hb")) / 2
    info = F.when(F.col("mi") < 1e-14, 0.0).otherwise(F.col("mi"))
    eps = F.lit(2.220446049250313e-16)
    gap = mean_h - F.col("emi")
    gap = F.when(gap < 0, F.least(gap, -eps)).otherwise(F.greatest(gap, eps))
    return d.select(
        *by, ari.alias("ari"),
        F.when(trivial, 1.0).otherwise(F.when(info == 0, 0.0).otherwise(info / mean_h)).alias("nmi"),
        F.when(trivial, 1.0).otherwise((F.col("mi") - F.col("emi")) / gap).alias("ami"))
