"""What explains a score: group shift, strata, kinship, leak exposure, controlled leakage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness import settings as S
from likeness.functions.text import draw_key
from likeness.functions.vectors import dot, l2, vector_sum
from likeness.operators import metrics as M
from likeness.operators.classify import centroid_predictions, fold_scores
from likeness.operators.probe import probe_predictions
from likeness.operators.ranking import average_rank, hash_rank
from likeness.operators.similarity import _arrow, picked
from likeness.operators.splits import group_folds, stratified_folds, thinned_samples
from likeness.operators.templates import item_means
from likeness.session import bounded, durable

PERMUTATIONS_PER_TASK = 100


def predict(df: DataFrame, by: list[str], classifier: str, enrolment: str = "all", **options) -> DataFrame:
    run = {"centroid": centroid_predictions, "probe": probe_predictions}[classifier]
    return run(df, by, enrolment=enrolment, **options)


def usable_groups(df: DataFrame, by: list[str], label: str = "ind", grp: str = "grp",
                  min_items: int = S.MIN_ITEMS_PER_GROUP, min_groups: int = 2,
                  min_total: int = S.MIN_ITEMS_PER_UNIT) -> DataFrame:
    """Rows of large enough groups of individuals that keep enough groups and rows."""
    sizes = df.groupBy(*by, label, grp).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_items)
    units = sizes.groupBy(*by, label).agg(F.count("*").alias("_g"), F.sum("_n").alias("_t")).filter(
        (F.col("_g") >= min_groups) & (F.col("_t") >= min_total))
    kept = sizes.join(bounded(units), [*by, label], "left_semi").select(*by, label, grp)
    return df.join(bounded(kept), [*by, label, grp], "left_semi")


def domain_shift(df: DataFrame, by: list[str], classifier: str = "centroid", seed: int = S.SEED) -> DataFrame:
    """Inside each individual, predict the group. A lift above 1 means groups carry a signature.

    Each individual is a cell, so all of them are scored in one job.
    """
    rows = usable_groups(df, by)
    cell = [*by, "ind"]
    rows = stratified_folds(rows, cell, label="grp", k=S.N_FOLDS, adaptive=True, seed=seed, purpose="shift_fold", unique=True)
    preds = predict(rows, cell, classifier, "none", label="grp", q_cols=["item"])
    acc = fold_scores(preds, cell).groupBy(*cell).agg(F.avg("accuracy").alias("accuracy"))
    info = rows.groupBy(*cell).agg(F.countDistinct("grp").alias("n_groups"), F.count("*").alias("n_items"))
    return M.lift(info.join(acc, cell), "accuracy", "n_groups")


def within_stratum(df: DataFrame, by: list[str], classifier: str = "centroid") -> DataFrame:
    """Group-safe accuracy per stratum and over all rows (``__pooled__``)."""
    rows = df.withColumn("stratum", F.explode(F.array(F.lit(S.POOLED), F.col("stratum"))))
    cell = [*by, "stratum"]
    enough = rows.groupBy(*cell, "ind").agg(F.countDistinct("grp").alias("_g")).filter(F.col("_g") >= 2)
    rows = rows.join(bounded(enough.select(*cell, "ind")), [*cell, "ind"], "left_semi")
    info = rows.groupBy(*cell).agg(F.countDistinct("ind").alias("n_individuals"), F.count("*").alias("n_items"))
    info = bounded(info.filter((F.col("n_individuals") >= 3) & (F.col("n_items") >= S.MIN_ROWS)))
    rows = rows.join(info.select(*cell), cell, "left_semi")
    rows = group_folds(rows, cell)
    preds = predict(rows, cell, classifier, "all", q_cols=["item"])
    acc = fold_scores(preds, cell).groupBy(*cell).agg(F.avg("accuracy").alias("accuracy"))
    return M.lift(info.join(acc, cell, "left"), "accuracy", "n_individuals")


def kinship(df: DataFrame, by: list[str], permutations: int = S.N_PERMUTATIONS, seed: int = S.SEED) -> DataFrame:
    """Are individuals of one family closer than others? With a label-permutation p value.

    Individuals are unit vectors, so the similarities inside a family sum to
    (|sum u|^2 - sum |u|^2) / 2. One vector sum per family replaces every pair, in the data and
    in each permutation. Rows without a known family take no part.
    """
    known = df.filter(F.col("family").isNotNull() & ~F.col("family").isin(S.UNKNOWN_FAMILIES))
    people = known.groupBy(*by, "ind").agg(F.min("family").alias("family"), l2(vector_sum("v")).alias("u"))
    people = durable(people)

    def gaps(d: DataFrame, cell: list[str], family: str) -> DataFrame:
        fam = d.groupBy(*cell, family).agg(
            vector_sum("u").alias("s"), F.sum(dot("u", "u")).alias("q"), F.count("*").alias("m"))
        m = F.col("m").cast("double")
        tot = fam.groupBy(*cell).agg(
            vector_sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").cast("double").alias("k"),
            F.count("*").alias("n_families"),
            F.sum((dot("s", "s") - F.col("q")) / 2).alias("same"), F.sum(m * (m - 1) / 2).alias("n_same"))
        every = (dot("s", "s") - F.col("q")) / 2
        n_diff = F.col("k") * (F.col("k") - 1) / 2 - F.col("n_same")
        return tot.select(
            *cell, F.col("k").cast("long").alias("n_individuals"), "n_families",
            F.col("n_same").cast("long").alias("n_same"), n_diff.cast("long").alias("n_diff"),
            F.when(F.col("n_same") > 0, F.col("same") / F.col("n_same")).alias("same_sim"),
            F.when(n_diff > 0, (every - F.col("same")) / n_diff).alias("diff_sim"))

    # Equal partitions of the individuals must tie exactly, so gaps are rounded before they meet.
    gap = F.round(F.col("same_sim") - F.col("diff_sim"), 12)
    observed = gaps(people, by, "family").withColumn("gap", gap).filter(
        (F.col("n_families") >= 2) & (F.col("n_individuals") >= 3) & (F.col("n_same") >= 2) & (F.col("n_diff") >= 2))
    null = _shuffled_gaps(people, by, permutations, seed).withColumn("null_gap", gap).filter(F.col("null_gap").isNotNull())
    observed = bounded(observed)
    tail = null.join(observed.select(*by, "gap"), by).groupBy(*by).agg(
        ((F.count_if(F.col("null_gap") >= F.col("gap")) + 1) / (F.count("*") + 1)).alias("p_permutation"))
    return observed.join(tail, by, "left").select(
        *by, "n_individuals", "n_families", F.col("same_sim").alias("same_family_similarity"),
        F.col("diff_sim").alias("different_family_similarity"), "gap", "p_permutation",
        F.col("n_same").alias("n_same_family_pairs"), F.col("n_diff").alias("n_different_family_pairs"))


def _shuffled_gaps(people: DataFrame, by: list[str], permutations: int, seed: int, width: int = PERMUTATIONS_PER_TASK) -> DataFrame:
    """``by, perm, same_sim, diff_sim`` of every label shuffle.

    A shuffle gives the n-th individual of a random order the family of the n-th individual, so only keys are
    ranked. Each individual then holds one family number per shuffle and travels once per range of ``width``
    shuffles; a task turns a range into sparse indicator blocks and adds up family sums, without pairs.
    """
    families = hash_rank(people.select(*by, "family").distinct(), by, F.md5("family"), "_code", tie=["family"])
    seats = hash_rank(people.select(*by, "ind", "family"), by, F.md5("ind"), "_p", tie=["ind"]).join(families, [*by, "family"]).select(
        *by, "_p", (F.col("_code") - 1).cast("int").alias("_f"))
    drawn = people.select(*by, "ind").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    drawn = hash_rank(drawn, [*by, "perm"], draw_key("kinship", "perm", "ind", seed=seed), "_p", tie=["ind"]).join(seats, [*by, "_p"])
    ranges = drawn.withColumn("_range", F.floor(F.col("perm") / width).cast("int")).groupBy(*by, "ind", "_range").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("perm", "_f"))), lambda x: x["_f"]).alias("_fs"))
    rows = ranges.join(people.select(*by, "ind", "u"), [*by, "ind"])
    number = T.DoubleType()
    schema = T.StructType([people.schema[c] for c in by] + [
        T.StructField("perm", T.IntegerType()), T.StructField("_f", T.IntegerType()),
        T.StructField("s", T.ArrayType(number)), T.StructField("q", number), T.StructField("m", number)])
    arrow = _arrow(schema)

    def run(batches):
        for b in batches:
            keys = {}
            for i, key in enumerate(zip(*[b.column(c).to_pylist() for c in [*by, "_range"]])):
                keys.setdefault(key, []).append(i)
            out = {name: [] for name in schema.fieldNames()}
            for key, at in keys.items():
                at = np.asarray(at)
                u, fs = picked(b.column("u"), at), picked(b.column("_fs"), at)
                square = (u * u).sum(axis=1)
                for j in range(fs.shape[1]):
                    found, code = np.unique(fs[:, j], return_inverse=True)
                    indicator = np.zeros((len(found), len(u)))
                    indicator[code, np.arange(len(u))] = 1.0
                    n = len(found)
                    for c, v in zip(by, key):
                        out[c] += [v] * n
                    out["perm"] += [key[-1] * width + j] * n
                    out["_f"] += found.tolist()
                    out["s"] += list(indicator @ u)
                    out["q"] += (indicator @ square).tolist()
                    out["m"] += indicator.sum(axis=1).tolist()
            yield from pa.Table.from_pydict(out, schema=arrow).to_batches()

    parts = rows.select(*by, "_range", "_fs", "u").mapInArrow(run, schema)
    fam = parts.groupBy(*by, "perm", "_f").agg(vector_sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("m"))
    m = F.col("m")
    tot = fam.groupBy(*by, "perm").agg(
        vector_sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("k"),
        F.sum((dot("s", "s") - F.col("q")) / 2).alias("same"), F.sum(m * (m - 1) / 2).alias("n_same"))
    n_diff = F.col("k") * (F.col("k") - 1) / 2 - F.col("n_same")
    return tot.select(
        *by, "perm", F.when(F.col("n_same") > 0, F.col("same") / F.col("n_same")).alias("same_sim"),
        F.when(n_diff > 0, ((dot("s", "s") - F.col("q")) / 2 - F.col("same")) / n_diff).alias("diff_sim"))


def split_structure(df: DataFrame, by: list[str], ind: str = "ind", grp: str = "grp", k: int = S.N_FOLDS) -> DataFrame:
    """How much could a leaky split reunite? From group sizes alone.

    Rows are counted once per (group, individual). That count table is written out and everything
    else is computed from it, so the rows themselves are read and joined once.
    """
    base = durable(df.groupBy(*by, grp, ind).agg(F.count("*").alias("_n")))
    per_group = base.groupBy(*by, grp).agg(F.sum("_n").alias("n"))
    per_ind = base.groupBy(*by, ind).agg(F.count("*").alias("g"))
    n, share = F.col("n").cast("double"), 1.0 / k
    total = F.sum(n)
    groups = per_group.groupBy(*by).agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_groups"),
        F.percentile("n", F.lit(0.5)).alias("items_per_group_median"), F.avg(n).alias("items_per_group_mean"),
        (100 * F.count_if(F.col("n") == 1) / total).alias("pct_items_with_no_sibling"),
        (F.sum(n * (1 - F.pow(F.lit(share), n - 1))) / total).alias("p_any_sibling_in_train"),
        (F.sum(n * (1 - share) * (n - 1)) / total).alias("expected_siblings_in_train"))
    people = per_ind.groupBy(*by).agg(F.percentile("g", F.lit(0.5)).alias("groups_per_individual_median"))
    return groups.join(people, by)


def leakage_experiment(df: DataFrame, by: list[str], conditions=S.THINNING_CONDITIONS, draws: int = S.THINNING_DRAWS,
                       classifier: str = "centroid", min_eligible: int = 4, seed: int = S.SEED) -> DataFrame:
    """Hold individuals and rows constant, vary items per group, and compare both splits."""
    # Draws are small next to the table and feed every step below: written once, read from there.
    sample = thinned_samples(df, by, conditions, draws, seed=seed)
    sample = durable(sample.join(df.select(*by, "item", "v"), [*by, "item"]))
    cell = [*by, "groups", "items", "draw"]
    everyone = sample.groupBy(*by).agg(F.countDistinct("ind").alias("n_individuals")).filter(
        F.col("n_individuals") >= min_eligible)
    everyone = bounded(everyone)
    rows = sample.join(everyone.select(*by), by, "left_semi")
    split = F.col("split")
    both = group_folds(rows, cell).withColumn("split", F.lit("group")).unionByName(
        stratified_folds(rows, cell, seed=seed, purpose="thin_fold", unique=True).withColumn("split", F.lit("random")))
    preds = predict(both, [*cell, "split"], classifier, "all", q_cols=["item"])
    acc = fold_scores(preds, [*cell, "split"]).groupBy(*cell).agg(
        F.avg(F.when(split == "group", F.col("accuracy"))).alias("g"),
        F.avg(F.when(split == "random", F.col("accuracy"))).alias("r"))
    delta = F.col("r") - F.col("g")
    return acc.filter(F.col("g").isNotNull() & F.col("r").isNotNull()).groupBy(*by, "groups", "items").agg(
        F.avg("g").alias("accuracy_by_group"), F.avg("r").alias("accuracy_random"),
        F.avg(delta).alias("leakage_delta"), F.stddev_pop(delta).alias("leakage_delta_sd"),
        F.count("*").alias("n_draws"),
    ).join(everyone, by).select(
        *by, F.col("groups").alias("groups_per_individual"), F.col("items").alias("items_per_group"),
        (F.col("groups") * F.col("items")).alias("items_per_individual"), "n_individuals",
        "accuracy_by_group", "accuracy_random", "leakage_delta", "leakage_delta_sd", "n_draws")


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Spearman correlation over the rows of a small result table."""
    ranked = average_rank(average_rank(df, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias(out), F.count("*").alias("n"))


def item_set_gain(df: DataFrame, by: list[str], kind: str = "kind", base: str = "single",
                  classifier: str = "centroid") -> DataFrame:
    """Accuracy with the base item set against accuracy with every item."""
    sets = F.when(F.col(kind) == base, F.array(F.lit("base"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    rows = df.withColumn("item_set", F.explode(sets))
    cell = [*by, "item_set"]
    ok = rows.groupBy(*cell).agg(
        F.count("*").alias("_n"), F.countDistinct("ind").alias("_k"), F.countDistinct("item").alias("n_items"))
    ok = bounded(ok.filter((F.col("_n") >= S.MIN_ROWS) & (F.col("_k") >= 2)).drop("_n", "_k"))
    rows = group_folds(rows.join(ok.select(*cell), cell, "left_semi"), cell)
    acc = M.over_folds(fold_scores(predict(rows, cell, classifier, "all"), cell), cell, ["accuracy"])
    both = ok.join(acc, cell, "left")
    pick = lambda s, c: F.max(F.when(F.col("item_set") == s, F.col(c)))
    wide = both.groupBy(*by).agg(
        pick("base", "n_items").alias("base_n_items"), pick("base", "accuracy").alias("base_accuracy"),
        pick("base", "accuracy_sd").alias("base_sd"), pick("all", "n_items").alias("all_n_items"),
        pick("all", "accuracy").alias("all_accuracy"), pick("all", "accuracy_sd").alias("all_sd"))
    return wide.withColumn("gain", F.col("all_accuracy") - F.col("base_accuracy"))
