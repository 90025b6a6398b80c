"""Score frozen vectors: one result row per cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness import settings as S
from likeness.operators import metrics as M
from likeness.operators.classify import (
    centroid_predictions, encounter_predictions, fold_scores, verification)
from likeness.operators.cluster import clustering
from likeness.operators.probe import probe_predictions
from likeness.operators.splits import group_folds, stratified_folds
from likeness.session import bounded


def scorable(df: DataFrame, by: list[str], min_rows: int = S.MIN_ROWS, min_individuals: int = 2) -> DataFrame:
    """Rows of cells that are large enough to score."""
    ok = df.groupBy(*by).agg(F.count("*").alias("_n"), F.countDistinct("ind").alias("_k")).filter(
        (F.col("_n") >= min_rows) & (F.col("_k") >= min_individuals)).select(*by)
    return df.join(bounded(ok), by, "left_semi")


def inventory(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a cell."""
    return df.groupBy(*by).agg(
        F.countDistinct("item").alias("n_items"), F.count("*").alias("n_windows"),
        F.countDistinct("ind").alias("n_individuals"), F.countDistinct("grp").alias("n_groups"),
        F.max(F.size("v")).alias("dim"))


def chance_baselines(df: DataFrame, by: list[str]) -> DataFrame:
    """1/n and the majority rate over distinct items."""
    items = df.groupBy(*by, "ind").agg(F.countDistinct("item").alias("_n"))
    return items.groupBy(*by).agg(
        (1.0 / F.count("*")).alias("chance_inverse_n_individuals"),
        (F.max("_n") / F.sum("_n")).alias("chance_majority_class"))


def with_split(df: DataFrame, by: list[str], split: str, grain: str = "item", **options) -> DataFrame:
    """``group``: no group on both sides. ``random``: the leaky upper bound, dealt over items
    (``grain="window"`` deals windows)."""
    if split == "group":
        return group_folds(df, by, **options)
    item = ["item"] if grain == "item" else ["item", "window"]
    return stratified_folds(df, by, item=item, **options)


def both_splits(df: DataFrame, by: list[str], grain: str = "item") -> DataFrame:
    return with_split(df, by, "group").withColumn("split", F.lit("group")).unionByName(
        with_split(df, by, "random", grain).withColumn("split", F.lit("random")))


def fused_scores(preds: DataFrame, by: list[str]) -> DataFrame:
    """Item-level scores pooled over all folds, after a vote among the windows of an item."""
    return M.classification_scores(M.vote(preds, by, ["fold", "window"]), by)


def leakage_delta(df: DataFrame, by: list[str], predict=centroid_predictions, grain: str = "item") -> DataFrame:
    """Random minus group split, for accuracy and macro-F1 of item-level predictions."""
    preds = predict(both_splits(df, by, grain), [*by, "split"])
    return _delta(fused_scores(preds, [*by, "split"]), by)


def _delta(scores: DataFrame, by: list[str]) -> DataFrame:
    pick = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    wide = scores.groupBy(*by).agg(
        pick("group", "accuracy").alias("accuracy_group"), pick("random", "accuracy").alias("accuracy_random"),
        pick("group", "macro_f1").alias("macro_f1_group"), pick("random", "macro_f1").alias("macro_f1_random"))
    return (
        wide.withColumn("accuracy_leakage_delta", F.col("accuracy_random") - F.col("accuracy_group"))
        .withColumn("macro_f1_leakage_delta", F.col("macro_f1_random") - F.col("macro_f1_group"))
    )


def score(df: DataFrame, by: list[str], n_init: int = 10) -> tuple[DataFrame, DataFrame]:
    """The result row of every cell, and the item-level probe predictions behind it.

    ``accuracy_group`` is pooled over folds per item; ``accuracy_group_sd`` is the SD of the
    per-fold window accuracy.
    """
    df = scorable(df, by)
    cell = [*by, "split"]
    splits = both_splits(df, by).persist()      # probe, templates and encounters read it: vectors meet their folds once
    probe = probe_predictions(splits, cell).persist()
    windows = M.over_folds(fold_scores(probe, cell), cell, ["accuracy"]).filter(F.col("split") == "group").select(
        *by, F.col("accuracy").alias("accuracy_group_window_level"), F.col("accuracy_sd").alias("accuracy_group_sd"))
    centroid = M.over_folds(
        fold_scores(centroid_predictions(splits, cell), cell), cell, ["accuracy", "macro_f1"])
    pick = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    centroid = centroid.groupBy(*by).agg(
        pick("group", "accuracy").alias("centroid_accuracy_group"),
        pick("random", "accuracy").alias("centroid_accuracy_random"),
        pick("group", "macro_f1").alias("centroid_macro_f1_group"))
    encounter = M.over_folds(
        fold_scores(encounter_predictions(splits.filter(F.col("split") == "group"), by), by), by, ["accuracy"]
    ).select(*by, F.col("accuracy").alias("encounter_accuracy"))
    pairs = verification(df, by).select(
        *by, F.col("auc").alias("verification_auc"), F.col("eer").alias("verification_eer"))
    parts = [inventory(df, by), chance_baselines(df, by), _delta(fused_scores(probe, cell), by), windows, centroid,
             encounter, pairs, clustering(df, by, n_init=n_init)]
    row = reduce(lambda a, b: a.join(b, by, "left"), [bounded(p) for p in parts])
    preds = probe.filter(F.col("split") == "group").select(*by, "item", "window", "truth", "pred")
    return row, preds
