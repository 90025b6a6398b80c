"""Identification: nearest template, nearest neighbours, pooled encounters, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness import settings as S
from likeness.functions.text import draw_key
from likeness.functions.vectors import l2
from likeness.operators import metrics as M
from likeness.operators.ranking import first_by_key
from likeness.operators.similarity import nearest, pair_histogram, score_histogram
from likeness.operators.templates import enrolled, fold_sums, fold_templates, pooled_queries, templates
from likeness.session import bounded, is_small

KNOWN = "__known__"


def centroid_predictions(df: DataFrame, by: list[str], label: str = "ind", q_cols: list[str] | None = None,
                         v: str = "v", enrolment: str = "all", **nearest_options) -> DataFrame:
    """Nearest class template for the test rows of every fold.

    enrolment  "all"   only folds whose train side holds every individual
               "rows"  every fold, without test rows of individuals absent from its train side
               "none"  every fold, every row
    Output: ``by, fold, q_cols, truth, pred, score``.
    """
    q_cols = q_cols or ["item", "window"]
    sums = fold_sums(df, by, label, v)
    temps = fold_templates(sums, by, label)
    queries = df.withColumn("_q", l2(v)).withColumn("truth", F.col(label))
    if enrolment == "all":
        queries = queries.join(enrolled(sums, by, label), [*by, "fold"], "left_semi")
    elif enrolment == "rows":
        queries = queries.join(
            bounded(temps.select(*by, "fold", label), source=sums), [*by, "fold", label], "left_semi")
    elif enrolment != "none":
        raise ValueError(f"unknown enrolment {enrolment!r}")
    found = nearest(queries, temps.withColumnRenamed(label, "pred"), [*by, "fold"],
                    [*q_cols, "truth"], ["pred"], k=1, q_vec="_q", proven_small=is_small(sums), **nearest_options)
    return found.drop("rank")


def fold_scores(preds: DataFrame, by: list[str]) -> DataFrame:
    return M.classification_scores(preds, [*by, "fold"])


def encounter_predictions(df: DataFrame, by: list[str], label: str = "ind", grp: str = "grp",
                          v: str = "v", **nearest_options) -> DataFrame:
    """Pool the test rows of one individual in one group, then match the pool."""
    sums = fold_sums(df, by, label, v)
    temps = fold_templates(sums, by, label)
    queries = pooled_queries(
        df.join(enrolled(sums, by, label), [*by, "fold"], "left_semi").withColumn("_u", l2(v)),
        [*by, "fold"], label, grp, "_u").withColumn("truth", F.col(label))
    return nearest(queries, temps.withColumnRenamed(label, "pred"), [*by, "fold"], [grp, "truth"], ["pred"],
                   k=1, q_vec="_u", proven_small=is_small(sums), **nearest_options).drop("rank")


def knn_predictions(queries: DataFrame, refs: DataFrame, on: list[str], q_cols: list[str],
                    r_key: list[str], r_label: str = "pred", k: int = S.KNN_K, q_vec: str = "v",
                    r_vec: str = "t", **nearest_options) -> DataFrame:
    """Vote among the ``k`` nearest references (all of them if there are fewer).

    A tie in votes goes to the lowest label; a tie in score to the lowest reference key.
    """
    found = nearest(queries, refs, on, q_cols, [*r_key, r_label], k, q_vec, r_vec, **nearest_options)
    votes = found.groupBy(*on, *q_cols, r_label).agg(F.count("*").alias("_n"))
    return votes.groupBy(*on, *q_cols).agg(
        F.min_by(r_label, F.struct(-F.col("_n"), r_label)).alias(r_label))


def verification(df: DataFrame, by: list[str], **options) -> DataFrame:
    """``by, n_pos, n_neg, auc, eer`` over pairs of rows."""
    return M.auc_eer(pair_histogram(df, by, **options), by)


def open_set_scores(known_refs: DataFrame, known_test: DataFrame, novel: DataFrame, by: list[str],
                    label: str = "ind", v: str = "v", item: list[str] | None = None, **nearest_options) -> DataFrame:
    """``by, auc``: does the best template similarity tell known from novel rows?"""
    item = item or ["item", "window"]
    temps = templates(known_refs, by, label, v).withColumnRenamed(label, "pred")
    queries = known_test.select(*by, *item, v, F.lit(True).alias("known")).unionByName(
        novel.select(*by, *item, v, F.lit(False).alias("known")))
    best = nearest(queries, temps, by, [*item, "known"], ["pred"], k=1, q_vec=v, **nearest_options)
    return M.auc_eer(score_histogram(best, by, "score", F.col("known")), by)


def few_shot_scores(known: DataFrame, novel: DataFrame, by: list[str], shots: list[int] | None = None,
                    draws: int = S.FEW_SHOT_DRAWS, label: str = "ind", v: str = "v", item: list[str] | None = None,
                    seed: int = S.SEED, **nearest_options) -> DataFrame:
    """``by, n_shot, accuracy``: enrol novel individuals from a few items, find them among all known ones.

    The nearest known row of a novel item does not depend on the draw, so it is searched once per
    cell; every draw only searches its own few support items. On equal scores the support item
    wins. The result is null when an individual has no item left to ask about.
    """
    shots = shots or S.FEW_SHOT_SHOTS
    item = item or ["item", "window"]
    ref = [f"ref_{c}" for c in item]
    as_ref = [F.col(c).alias(r) for c, r in zip(item, ref)]
    sizes = novel.groupBy(*by, label).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.min("_n").alias("_least"))
    near_known = nearest(
        novel, known.select(*by, *as_ref, F.col(v).alias("t")), by, item, ref, k=1, q_vec=v, **nearest_options
    ).select(*by, *item, F.col("score").alias("_known"))
    draw_ids = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    keys = novel.select(*by, label, *item).withColumn("draw", draw_ids)
    result = None
    for shot in shots:
        key = draw_key(f"support_{shot}", *(c for c in by if c != "model"), "draw", *item, seed=seed)
        chosen = bounded(first_by_key(keys, [*by, "draw", label], key, shot, item))
        support = chosen.join(novel.select(*by, *item, F.col(v).alias("t")), [*by, *item]).select(
            *by, "draw", F.col(label).alias("pred"), *as_ref, "t")
        asked = novel.withColumn("draw", draw_ids).join(
            chosen.select(*by, "draw", *item), [*by, "draw", *item], "left_anti").withColumn("truth", F.col(label))
        best = nearest(asked, support, [*by, "draw"], [*item, "truth"], [*ref, "pred"], k=1, q_vec=v,
                       **nearest_options)
        judged = best.join(near_known, [*by, *item], "left").withColumn(
            "pred", F.when(F.col("_known") > F.col("score"), KNOWN).otherwise(F.col("pred")))
        per_draw = M.classification_scores(judged, [*by, "draw"])
        mean = per_draw.groupBy(*by).agg(F.avg("balanced_accuracy").alias("_a"))
        one = sizes.join(mean, by, "left").select(
            *by, F.lit(shot).alias("n_shot"), F.when(F.col("_least") > shot, F.col("_a")).alias("accuracy"))
        result = one if result is None else result.unionByName(one)
    return result
