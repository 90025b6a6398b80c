"""Folds, hold-outs and samples. All of them are functions of row keys and a seed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness import settings as S
from likeness.functions.text import draw_key
from likeness.operators.ranking import first_by_key, hash_rank, running_total
from likeness.operators.templates import enrolled
from likeness.session import bounded, one_thread_per_task


def _deal_segments(hist: pd.DataFrame, k_max: int) -> list[tuple]:
    """Deal groups, largest first, each to the lightest fold (ties: lowest fold).

    ``hist`` has one row per distinct group size, not per group. Equal sizes ``s`` put fold j's
    t-th pick at load ``L_j + t*s``, so the greedy order is the merge of k arithmetic sequences
    with one common step: between two folds joining in, it simply cycles. Each cycle is one
    segment (size, first rank, end rank, folds in cyclic order).
    """
    k = int(min(k_max, hist["c"].sum()))
    loads = [0] * k
    out = []
    for s, c in sorted(zip(hist["n"].astype(int), hist["c"].astype(int)), reverse=True):
        s, c = int(s), int(c)
        low = min(loads)
        joins = [((load - low) // s, (load - low) % s, j) for j, load in enumerate(loads)]
        levels = sorted({q for q, _, _ in joins})
        start = 0
        for i, level in enumerate(levels):
            if start >= c:
                break
            active = [j for _, j in sorted((r, j) for q, r, j in joins if q <= level)]
            room = c - start
            if i + 1 < len(levels):
                room = min(room, (levels[i + 1] - level) * len(active))
            out.append((s, start, start + room, active))
            for pos, j in enumerate(active):
                loads[j] += s * (room // len(active) + (pos < room % len(active)))
            start += room
    return out


def group_fold_table(df: DataFrame, by: list[str], grp: str = "grp", k: int = S.N_FOLDS,
                     strategy: str = "greedy", seed: int = S.SEED) -> DataFrame:
    """One row per group: ``by, grp, n, fold``. A cell with fewer than ``k`` groups gets fewer folds.

    greedy    largest group to the lightest fold; equal sizes in digest order
    rank_mod  position in size order, modulo k
    hash      digest of the group key modulo k (no order at all)
    """
    one_thread_per_task(df)
    sizes = df.groupBy(*by, grp).agg(F.count("*").alias("n"))
    key = draw_key("group_fold", grp, seed=seed)
    if strategy == "hash":
        value = F.conv(F.left(key, F.lit(12)), 16, 10).cast("long")
        return sizes.withColumn("fold", F.pmod(value, F.lit(k)).cast("int"))
    if strategy not in ("greedy", "rank_mod"):
        raise ValueError(f"unknown strategy {strategy!r}")
    hist = sizes.groupBy(*by, "n").agg(F.count("*").alias("c"))
    ranked = running_total(sizes, [*by, "n"], key, "_r", tie=[grp])
    if strategy == "rank_mod":
        w = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_start", F.coalesce(F.sum("c").over(w), F.lit(0)))
        return (
            ranked.join(bounded(hist.drop("c")), [*by, "n"])
            .withColumn("fold", F.pmod(F.col("_start") + F.col("_r"), F.lit(k)).cast("int"))
            .select(*by, grp, "n", "fold")
        )

    schema = T.StructType(
        [hist.schema[c] for c in by]
        + [T.StructField("n", T.LongType()), T.StructField("_from", T.LongType()),
           T.StructField("_to", T.LongType()), T.StructField("_folds", T.ArrayType(T.IntegerType()))]
    )

    def deal(key_values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(key_values) + seg for seg in _deal_segments(pdf, k)]
        return pd.DataFrame(rows, columns=schema.fieldNames())

    segments = hist.groupBy(*by).applyInPandas(deal, schema)
    return (
        ranked.join(bounded(segments), [*by, "n"])
        .filter((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")))
        .withColumn("fold", F.get("_folds", ((F.col("_r") - F.col("_from")) % F.size("_folds")).cast("int")))
        .select(*by, grp, "n", "fold")
    )


def group_folds(df: DataFrame, by: list[str], grp: str = "grp", k: int = S.N_FOLDS,
                strategy: str = "greedy", seed: int = S.SEED) -> DataFrame:
    """Add ``fold``; all rows of a group share it."""
    table = group_fold_table(df, by, grp, k, strategy, seed).drop("n")
    return df.join(bounded(table), [*by, grp])


def stratified_folds(df: DataFrame, by: list[str], label: str = "ind", item: list[str] | None = None,
                     k: int = S.N_FOLDS, adaptive: bool = False, seed: int = S.SEED,
                     purpose: str = "stratified_fold", unique: bool = False) -> DataFrame:
    """Add ``fold``: rows in (label, digest) order are dealt round-robin.

    ``adaptive`` lowers k to the smallest class of the cell. The key is ``item``: windows of one
    item stay together. Add ``window`` to ``item`` to deal windows instead. ``unique`` promises one
    row per ``item`` and saves the distinct and the join back.
    """
    item = item or ["item"]
    units = df if unique else df.select(*by, label, *item).distinct()
    classes = units.groupBy(*by, label).agg(F.count("*").alias("_n"))
    classes = running_total(classes, by, F.md5(F.col(label).cast("string")), "_start", F.col("_n"), tie=[label])
    if adaptive:
        least = classes.groupBy(*by).agg(F.min("_n").alias("_least"))
        classes = classes.join(least, by) if by else classes.crossJoin(least)     # one row without by
        classes = classes.withColumn("_kk", F.least(F.lit(k), "_least")).drop("_least")
    else:
        classes = classes.withColumn("_kk", F.lit(k).cast("long"))
    placed = running_total(units, [*by, label], draw_key(purpose, *item, seed=seed), "_r", tie=item)
    fold = F.pmod(F.col("_start") + F.col("_r"), F.col("_kk")).cast("int").alias("fold")
    placed = placed.join(bounded(classes.drop("_n")), [*by, label])
    if unique:
        return placed.select(*df.columns, fold)
    return df.join(placed.select(*by, *item, fold), [*by, *item])


def fold_sizes(df: DataFrame, by: list[str], label: str = "ind") -> DataFrame:
    """``by, fold, label, n`` - the only pass over rows that enrolment rules need."""
    return df.groupBy(*by, "fold", label).agg(F.count("*").alias("n"))


def enrolled_folds(df: DataFrame, by: list[str], label: str = "ind") -> DataFrame:
    """Folds whose train side holds every individual (``by, fold``)."""
    return enrolled(bounded(fold_sizes(df, by, label)), by, label)


def leak_check(df: DataFrame, by: list[str], grp: str = "grp", label: str = "ind") -> DataFrame:
    """Per cell: groups seen in more than one fold, folds in use, folds that enrol everybody."""
    spans = df.groupBy(*by, grp).agg(F.countDistinct("fold").alias("_f"))
    leaks = spans.groupBy(*by).agg(F.sum((F.col("_f") > 1).cast("long")).alias("leaking_groups"))
    used = df.groupBy(*by).agg(F.countDistinct("fold").alias("n_folds"))
    full = enrolled_folds(df, by, label).groupBy(*by).agg(F.count("*").alias("_e"))
    return (
        leaks.join(used, by).join(full, by, "left")
        .select(*by, "leaking_groups", "n_folds", F.coalesce("_e", F.lit(0)).alias("enrolled_folds"))
    )


def _repeat(by: list[str]) -> list[str]:
    """The cell columns a random draw depends on: all models of a repeat draw the same items."""
    return [c for c in by if c != "model"]


def within_label_split(df: DataFrame, by: list[str], label: str = "ind", item: list[str] | None = None,
                       test_fraction: float = S.KNOWN_TEST_FRACTION, seed: int = S.SEED,
                       purpose: str = "within_split") -> DataFrame:
    """Add ``is_test``: the last items of each individual; at least one item stays in training."""
    item = item or ["item"]
    ranked = hash_rank(df, [*by, label], draw_key(purpose, *_repeat(by), *item, seed=seed), "_r", tie=item)
    cuts = df.groupBy(*by, label).agg(
        F.greatest(F.lit(1), F.rint(F.count("*") * (1 - test_fraction))).alias("_cut"))
    return (
        ranked.join(bounded(cuts), [*by, label])
        .withColumn("is_test", F.col("_r") > F.col("_cut")).drop("_r", "_cut")
    )


def validation_split(df: DataFrame, by: list[str], label: str = "ind", item: list[str] | None = None,
                     fraction: float = S.VALIDATION_FRACTION, seed: int = S.SEED) -> DataFrame:
    """Add ``is_validation``: a slice of each class that never takes the whole class."""
    item = item or ["item"]
    ranked = hash_rank(df, [*by, label], draw_key("validation", *_repeat(by), *item, seed=seed), "_r", tie=item)
    n = F.count("*")
    cuts = df.groupBy(*by, label).agg(
        F.when(n >= 2, F.least(F.greatest(F.lit(1.0), F.rint(n * fraction)), n - 1.0))
        .otherwise(0.0).alias("_cut"))
    return (
        ranked.join(bounded(cuts), [*by, label])
        .withColumn("is_validation", F.col("_r") <= F.col("_cut")).drop("_r", "_cut")
    )


def held_out_individuals(df: DataFrame, by: list[str], label: str = "ind",
                         repeats: int = S.HOLDOUT_REPEATS, n: int = S.HOLDOUT_INDIVIDUALS,
                         seed: int = S.SEED) -> DataFrame:
    """``by, repeat, ind``: the individuals left out in each repeat."""
    everyone = df.select(*by, label).distinct()
    everyone = everyone.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return first_by_key(everyone, [*by, "repeat"], draw_key("hold_out", "repeat", label, seed=seed), n, [label])


def held_out_names(held: DataFrame, by: list[str], label: str = "ind") -> DataFrame:
    """``a|b|c`` per repeat (the list has ``n`` entries by construction)."""
    return held.groupBy(*by, "repeat").agg(
        F.array_join(F.sort_array(F.collect_list(label)), "|").alias("held_out"))


def eligible_individuals(df: DataFrame, by: list[str], conditions=S.THINNING_CONDITIONS,
                         label: str = "ind", grp: str = "grp") -> DataFrame:
    """Individuals that can supply every (groups, items per group) condition."""
    sizes = df.groupBy(*by, label, grp).agg(F.count("*").alias("_n"))
    ok = F.lit(True)
    for groups, items in conditions:
        ok = ok & (F.count_if(F.col("_n") >= items) >= groups)
    return sizes.groupBy(*by, label).agg(ok.alias("_ok")).filter("_ok").drop("_ok")


def thinned_samples(df: DataFrame, by: list[str], conditions=S.THINNING_CONDITIONS,
                    draws: int = S.THINNING_DRAWS, label: str = "ind", grp: str = "grp",
                    seed: int = S.SEED) -> DataFrame:
    """Balanced samples: ``by, groups, items, draw, ind, grp, item``.

    Groups are drawn on the group table first; item keys join only the drawn groups, and vectors
    stay out of it. Both draws are prunable top-n windows.
    """
    plan = F.array(*[F.struct(F.lit(r).alias("groups"), F.lit(c).alias("items")) for r, c in conditions])
    eligible = bounded(eligible_individuals(df, by, conditions, label, grp))
    base = df.select(*by, label, grp, "item").join(eligible, [*by, label], "left_semi")
    sizes = base.groupBy(*by, label, grp).agg(F.count("*").alias("_n"))
    cells = (
        sizes.withColumn("_c", F.explode(plan)).select("*", "_c.groups", "_c.items").drop("_c")
        .filter(F.col("_n") >= F.col("items"))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    )
    cell = [*by, "groups", "items", "draw"]
    w = Window.partitionBy(*cell, label).orderBy(
        draw_key("thin_group", "groups", "items", "draw", label, grp, seed=seed), grp)
    most_groups = max(r for r, _ in conditions)
    most_items = max(c for _, c in conditions)
    chosen = (
        cells.withColumn("_r", F.row_number().over(w))
        .filter((F.col("_r") <= most_groups) & (F.col("_r") <= F.col("groups")))
        .select(*cell, label, grp)
    )
    w = Window.partitionBy(*cell, label, grp).orderBy(
        draw_key("thin_item", "groups", "items", "draw", "item", seed=seed), "item")
    return (
        base.join(chosen, [*by, label, grp])
        .withColumn("_r", F.row_number().over(w))
        .filter((F.col("_r") <= most_items) & (F.col("_r") <= F.col("items")))
        .select(*cell, label, grp, "item")
    )
