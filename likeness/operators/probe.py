"""Linear probe: multinomial logistic regression, refitted in every fold.

Each fold's fit is a row of a model table: weights on raw vectors, the scaler folded in. A fit sees all train rows:
in one task up to ``fit_rows`` rows of a cell, above in passes over all rows; every test row is scored from the
table in one pass.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.vectors import standardise
from likeness.operators.models import FIT_ROWS, apply_models, fit_models
from likeness.operators.passes import add_up, by_cell, held, run_fits
from likeness.operators.similarity import _arrow, matrix
from likeness.operators.splits import enrolled_folds
from likeness.operators.templates import fold_scalers
from likeness.session import bounded, one_thread_per_task

MODEL = "classes array<string>, w array<double>, dim int, n_fit long, n_train double, gradient double"


def _ridge(dim: int, c: float, n: float) -> np.ndarray:
    """The penalty per weight; the intercept is free."""
    return np.append(np.full(dim, 1.0 / (c * n)), 0.0)[:, None]


def _softmax_loss(x: np.ndarray, y: np.ndarray, k: int, c: float):
    """A function from weights to (value, gradient)."""
    n = len(x)
    xb = np.hstack([x, np.ones((n, 1))])
    target = np.eye(k)[y]
    ridge = _ridge(x.shape[1], c, n)

    def loss(w):
        s = xb @ w
        s -= s.max(axis=1, keepdims=True)
        e = np.exp(s)
        z = e.sum(axis=1, keepdims=True)
        value = float((np.log(z) - (s * target).sum(axis=1, keepdims=True)).sum() / n + 0.5 * (ridge * w * w).sum())
        return value, xb.T @ ((e / z - target) / n) + ridge * w

    return loss


def _descent(shape: tuple[int, int], max_iter: int, tol: float = 1e-6) -> Generator:
    """L-BFGS from zero: yields weights, is sent their (value, gradient), returns the last weights and their gradient."""
    w = np.zeros(shape)
    f, g = yield w
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        if np.abs(g).max() < tol:
            break
        step, alphas = g.copy(), []
        for s, r, rho in reversed(memory):
            a = rho * (s * step).sum()
            alphas.append(a)
            step -= a * r
        if memory:
            s, r, _ = memory[-1]
            step *= (s * r).sum() / (r * r).sum()
        for (s, r, rho), a in zip(memory, reversed(alphas)):
            step += s * (a - rho * (r * step).sum())
        slope, t = -(g * step).sum(), 1.0
        while True:
            w2 = w - t * step
            f2, g2 = yield w2
            if f2 <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t *= 0.5
        s, r = w2 - w, g2 - g
        if (s * r).sum() > 1e-14:
            memory = (memory + [(s, r, 1.0 / (s * r).sum())])[-10:]
        done = abs(f - f2) <= 1e-13 * max(1.0, abs(f))
        w, f, g = w2, f2, g2
        if done:
            break
    return w, g


def _fit_softmax(x: np.ndarray, y: np.ndarray, k: int, c: float, max_iter: int, tol: float = 1e-6) -> np.ndarray:
    """Minimise mean cross-entropy + |w|^2 / (2·c·n) by L-BFGS over the rows at hand."""
    loss = _softmax_loss(x, y, k, c)
    return run_fits([_descent((x.shape[1] + 1, k), max_iter, tol)], lambda asked: {i: loss(w) for i, w in asked.items()})[0][0]


def _model(classes, w: np.ndarray, mean: np.ndarray, sd: np.ndarray, n: int, gradient: np.ndarray) -> dict:
    slope = w[:-1] / np.where(sd == 0, 1.0, sd)[:, None]
    raw = np.vstack([slope, w[-1] - mean @ slope])
    return {"classes": list(classes), "w": raw.ravel().tolist(), "dim": len(slope), "n_fit": n, "n_train": float(n),
            "gradient": float(np.abs(gradient).max())}


def _fit_in_passes(rows: DataFrame, folds: DataFrame, by: list[str], c: float, max_iter: int) -> list[dict]:
    """A model of every cell and fold of ``rows``; the driver knows classes, scalers and weights, tasks hold the rows."""
    counts = rows.groupBy(*by, "fold", "truth").agg(F.count("*").alias("n")).toArrow().to_pylist()
    inside: dict[tuple, list[dict]] = {}
    for r in counts:
        inside.setdefault(tuple(r[b] for b in by), []).append(r)
    fits, cells = [], {}
    for one in folds.toArrow().to_pylist():
        cell = tuple(one[b] for b in by)
        theirs = [r for r in inside.get(cell, ()) if r["fold"] != one["fit"]]
        if theirs:
            cells.setdefault(cell, []).append(len(fits))
            fits.append({**one, "mean": np.asarray(one["mean"]), "sd": np.asarray(one["sd"]),
                         "classes": sorted({r["truth"] for r in theirs}), "n": sum(r["n"] for r in theirs)})
    widest = max((len(one["mean"]) for one in fits), default=0)
    rows = held(rows.select(*by, "fold", "truth", "_v"), 8 * widest * sum(r["n"] for r in counts))

    def judge(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def body(batch: pa.Table):
            for cell, table in by_cell(batch, by):
                v, fold = matrix(table["_v"]), np.asarray(table["fold"])
                for i in cells.get(cell, ()):
                    m = np.flatnonzero(fold != fits[i]["fit"])
                    if i not in asked or not len(m):
                        continue
                    y = np.asarray(pc.index_in(table["truth"], value_set=pa.array(fits[i]["classes"])))[m]
                    x = (v[m] - fits[i]["mean"]) / np.where(fits[i]["sd"] == 0, 1.0, fits[i]["sd"])
                    value, gradient = _softmax_loss(x, y, len(fits[i]["classes"]), np.inf)(asked[i])
                    yield i, len(m) * np.append(value, gradient)

        out = {}
        for i, s in add_up(rows, body).items():
            w, n = asked[i], fits[i]["n"]
            ridge = _ridge(len(w) - 1, c, n)
            out[i] = s[0] / n + 0.5 * float((ridge * w * w).sum()), s[1:].reshape(w.shape) / n + ridge * w
        return out

    try:
        ends = run_fits([_descent((len(one["mean"]) + 1, len(one["classes"])), max_iter) for one in fits], judge)
    finally:
        rows.unpersist()
    return [{**{b: one[b] for b in by}, "fold": one["fit"], **_model(one["classes"], w, one["mean"], one["sd"], one["n"], g)}
            for one, (w, g) in zip(fits, ends)]


def probe_models(df: DataFrame, by: list[str], label: str = "ind", item: list[str] | None = None, v: str = "v",
                 enrolment: str = "all", c: float = 1.0, max_iter: int = 1500, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The model table: ``by, fold`` and, fitted on the other folds' rows, ``classes, w, dim, n_fit, n_train, gradient``.

    ``w`` holds (dim + 1) x classes weights row by row, the intercepts last, for vectors as they are. ``gradient`` is
    the largest entry of the loss's gradient at the end, on standardised vectors: 0 at the optimum. Cells of more than
    ``fit_rows`` rows are fitted in passes over them; either way a fit sees every train row.
    """
    one_thread_per_task(df)
    item = item or ["item", "window"]
    folds = fold_scalers(df, by, v).withColumnRenamed("fold", "fit")
    if enrolment == "all":
        folds = folds.join(enrolled_folds(df, by, label).withColumnRenamed("fold", "fit"), [*by, "fit"], "left_semi")
    elif enrolment != "none":
        raise ValueError(f"unknown enrolment {enrolment!r}")
    folds = folds.withColumn("fit", F.col("fit").cast("int"))
    rows = df.select(*by, "fold", *item, F.col(label).cast("string").alias("truth"), F.col(v).alias("_v")).where("truth is not null")
    large = bounded(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > fit_rows).select(*by))
    train = rows.join(large, by, "left_anti").join(folds, by).where("fold <> fit").select(
        *by, F.col("fit").alias("fold"), *item, "truth", "mean", "sd", standardise("_v", "mean", "sd").alias("_x"))

    def fit(group: pa.Table) -> dict | None:
        group = group.sort_by([(i, "ascending") for i in item])
        x = matrix(group["_x"])
        classes, y = np.unique(np.asarray(group["truth"].to_pandas()).astype(str), return_inverse=True)
        w = _fit_softmax(x, y, len(classes), c, max_iter)
        mean, sd = (np.asarray(group[m][0].as_py()) for m in ("mean", "sd"))
        return _model(classes.tolist(), w, mean, sd, len(x), _softmax_loss(x, y, len(classes), c)(w)[1])

    models = fit_models(train, [*by, "fold"], T._parse_datatype_string(MODEL).fields, fit)
    if large.isEmpty():
        return models
    found = _fit_in_passes(rows.join(large, by, "left_semi"), folds.join(large, by, "left_semi"), by, c, max_iter)
    table = pa.Table.from_pylist(found, schema=_arrow(models.schema))
    return models.unionByName(df.sparkSession.createDataFrame(table, models.schema))


def probe_predictions(df: DataFrame, by: list[str], label: str = "ind", q_cols: list[str] | None = None,
                      v: str = "v", enrolment: str = "all", **model_options) -> DataFrame:
    """Predictions for the test rows of every fold: ``by, fold, q_cols, truth, pred``."""
    q_cols = q_cols or ["item", "window"]
    models = probe_models(df, by, label, q_cols, v, enrolment, **model_options)
    rows = df.select(*by, F.col("fold").cast("int").alias("fold"), *q_cols, F.col(label).cast("string").alias("truth"), F.col(v).alias("_v"))

    def score(block: pa.Table, model: dict) -> dict:
        w = np.reshape(model["w"], (model["dim"] + 1, -1))
        best = (matrix(block["_v"]) @ w[:-1] + w[-1]).argmax(axis=1)
        return {"pred": np.asarray(model["classes"], object)[best]}

    return apply_models(rows, models, [*by, "fold"], q_cols, [T.StructField("pred", T.StringType())], score)
