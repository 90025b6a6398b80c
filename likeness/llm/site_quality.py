"""Quality: document evidence and hierarchical empirical Bayes posteriors of sites and paths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import slices, small_batches, stored, utf8, word_hashes
from likeness.llm.near_duplicates import BLANKS

FEATURES = 9
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?@=+"]] = True


def features(texts: pa.Array) -> np.ndarray:
    """Numbers that tell prose from junk, one row per text; all zero for a text without words."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), FEATURES))
    for lo, hi in slices(offsets):
        raw = data[offsets[lo]:offsets[hi]]
        bounds = offsets[lo:hi + 1] - offsets[lo]
        words, at = word_hashes(BLANKS[raw], bounds)
        sums = [np.concatenate([[0], np.cumsum(flag[raw], dtype=np.int64)]) for flag in (_CAPITAL, _SMALL, _DIGIT, _SIGN)]
        lines = np.concatenate([[0], np.cumsum(raw == 10, dtype=np.int64)])
        for i in range(hi - lo):
            w = words[at[i]:at[i + 1]]
            n, a, b = len(w), bounds[i], bounds[i + 1]
            if not n:
                continue
            capital, small, digit, sign = (s[b] - s[a] for s in sums)
            distinct = len(np.unique(w))
            size = float(b - a)
            out[lo + i] = (
                math.log1p(n) / 5, capital / max(1, capital + small), sign / size * 5, digit / size * 5,
                (w[1:] == w[:-1]).mean() if n > 1 else 0.0, distinct / n, math.log1p(n) / 5 * distinct / n,
                min(size / n, 30) / 10, math.log1p((lines[b] - lines[a]) / n * 50) / 3)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) by Newton steps on features and their squares."""
    x = expand(x)
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)


def _logit(p):
    return F.log(p / (1 - p))


def shrunk(cells: DataFrame, by: list[str], centre, strength: float) -> DataFrame:
    """Posterior mean of the share of good documents of each cell: a beta prior around ``centre``."""
    return cells.select(*by, ((F.col("good") + F.lit(strength) * centre) / (F.col("n") + F.lit(strength))).alias("share"))


def prior_strength(cells: DataFrame, mean) -> float:
    """Pseudo-documents of the prior, by moments: what the variance between cells leaves to sampling.

    Larger when cells are alike; between 1 and 10,000.
    """
    m = F.col("good") / F.col("n")
    r = cells.where("n >= 2").agg(
        F.sum(F.col("n") * (m - mean) * (m - mean)).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"),
        F.sum(F.col("spread")).alias("within")).first()
    if not r["cells"] or r["n"] <= r["cells"]:
        return 10.0
    within = max(r["within"] / r["n"], 1e-9)
    between = max(r["between"] / r["n"] - within * r["cells"] / r["n"], 1e-9)
    return float(min(max(within / between, 1.0), 10_000.0))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
            site_col: str = "source", path_col: str = "lang", fit_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with _evidence, _site, _path and _quality (posterior of a good document).

    A logistic classifier, fitted on at most about ``fit_rows`` labelled rows taken by a hash of the
    id, gives each document evidence (a log likelihood ratio). Summed probabilities per site and per
    path of a site give posterior shares of good documents: a site is shrunk toward the share of all
    documents, a path toward its site, each with a strength estimated from how much cells differ.
    The posterior of a document adds its evidence to the log-odds of its path. _keep is
    ``_quality >= threshold``.

    Empty and null texts have no evidence beyond their length; null sites and paths are cells of
    their own; rows with equal ids are judged one by one; without labels of both kinds every
    document is kept. Input columns stay, but for those named like the added ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_evidence", "_site", "_path_key", "_site_share", "_path_share", "_quality", "_keep")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_y"))
    share = min(1.0, fit_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0))), pa.list_(pa.float64())), batch.column(1)],
                                             names=["x", "y"])

    # about fit_rows ids and labels: a proven bound, for the broadcast as for the rows of numbers
    fit = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")
           .select("_t", "_y").mapInArrow(measured, "x array<double>, y int").toArrow())
    y = np.array(fit.column("y").to_pylist(), float)
    beta, base = None, 0.5
    if 0 < y.sum() < len(y):
        x = np.array(fit.column("x").to_pylist())
        beta, base = fit_logistic(x, y), float(y.mean())
    names = docs.columns
    at = names.index(text_col)
    offset = math.log(base / (1 - base))

    def judge(batches):
        for batch in batches:
            e = np.zeros(batch.num_rows) if beta is None else expand(features(batch.column(at))) @ beta - offset
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(e, -12, 12), pa.float64())], names=[*names, "_evidence"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    judged = docs.mapInArrow(judge, f"{kinds}, _evidence double")
    key = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in (site_col, path_col)]
    judged = judged.select("*", key[0].alias("_site"), key[1].alias("_path_key"))
    if beta is None:
        return judged.select(*names, "_evidence", F.lit(0.5).alias("_site_share"), F.lit(0.5).alias("_path_share"),
                             F.lit(0.5).alias("_quality"), F.lit(True).alias("_keep"))
    slim = docs.select(text_col, *(F.col(c) for c in {site_col, path_col} - {text_col}))
    slim_names = slim.columns
    at_slim = slim_names.index(text_col)

    def probability(batches):
        for batch in batches:
            e = expand(features(batch.column(at_slim))) @ beta
            keep = [c for i, c in enumerate(batch.columns) if i != at_slim]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(1 / (1 + np.exp(-np.clip(e, -12, 12))))],
                                             names=[*(c for c in slim_names if c != text_col), "p"])

    slim_kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in slim_names if c != text_col)
    cells = stored(slim.mapInArrow(probability, f"{slim_kinds}, p double").groupBy(key[0].alias("_site"), key[1].alias("_path_key")).agg(
        F.sum("p").alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("p")).alias("squares")))
    spread = F.col("squares") - F.col("good") * F.col("good") / F.col("n")
    paths = cells.select("*", spread.alias("spread"))
    sites = cells.groupBy("_site").agg(*(F.sum(c).alias(c) for c in ("good", "n", "squares"))).select("*", spread.alias("spread"))
    whole = cells.agg(F.sum("good"), F.sum("n")).first()
    mean = (whole[0] + 0.5) / (whole[1] + 1) if whole[1] else 0.5
    site_share = shrunk(sites, ["_site"], F.lit(mean), prior_strength(sites, F.lit(mean))).withColumnRenamed("share", "_site_share")
    nested = stored(paths.join(site_share, "_site"))
    path_share = nested.join(shrunk(nested, ["_site", "_path_key"], F.col("_site_share"), prior_strength(nested, F.col("_site_share"))),
                             ["_site", "_path_key"]).select("_site", "_path_key", "_site_share", F.col("share").alias("_path_share"))
    joined = judged.join(path_share, ["_site", "_path_key"], "left")
    limited = F.least(F.greatest("_path_share", F.lit(1e-4)), F.lit(1 - 1e-4))
    posterior = 1 / (1 + F.exp(-(F.col("_evidence") + _logit(limited))))
    return joined.select(*names, "_evidence", "_site_share", "_path_share", posterior.alias("_quality"),
                         (posterior >= threshold).alias("_keep"))
