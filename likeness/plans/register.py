"""The registered queries: operators applied to the given tables.

Roles: an embedding is an item, its label the individual, ``vec_id % 25`` its source group. Order
lines are items of customers grouped by order. Events are frames of fixed-length clips.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness import settings as S
from likeness.functions import text as X
from likeness.functions import vectors as V
from likeness.operators import classify as C
from likeness.operators import diagnostics as D
from likeness.operators import diff, features, lineage, quality, splits
from likeness.operators import metrics as M
from likeness.operators.cluster import clustering, kmeans_assign
from likeness.operators.head import FIT_ROWS as HEAD_ROWS
from likeness.operators.head import head_models as head_fits
from likeness.operators.inference import encode
from likeness.operators.models import fit_sample
from likeness.operators.probe import probe_models as probe_fits
from likeness.operators.probe import probe_predictions
from likeness.operators.reduce import component_models, principal_components
from likeness.operators.similarity import nearest
from likeness.operators.templates import fold_scalers, item_means
from likeness.plans import frozen, learned
from likeness.sources.sinks import long_predictions, wide_vectors
from likeness.sources.tables import subset
from likeness.streaming.incremental import pending

BY = ["model"]
CLIP = 200          # events per clip of the frame tables
WAVE = 4000         # samples per clip of the waveform tables
THIN = [(6, 2), (4, 3), (3, 4)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places; counts as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)     # no negative zero
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# Input frames ---------------------------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def identity(spark: SparkSession, sf: str) -> DataFrame:
    v = V.as_double("embedding")
    return table(spark, sf, "embeddings").select(
        F.lit("emb").alias("model"), F.col("vec_id").alias("item"), F.lit(0).alias("window"),
        F.col("label").cast("string").alias("ind"), (F.col("vec_id") % 25).cast("string").alias("grp"),
        (F.col("vec_id") % 4).cast("string").alias("stratum"), (F.col("label") % 3).cast("string").alias("family"),
        F.when(v[0] >= 0, "single").otherwise("repeated").alias("kind"), v.alias("v"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as two windows of half its length."""
    half = (F.size("v") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("w"), F.slice("v", F.lit(1), half).alias("x")),
                     F.struct(F.lit(1).alias("w"), F.slice("v", half + 1, half).alias("x")))
    return identity(spark, sf).withColumn("_h", F.explode(halves)).withColumns(
        {"window": F.col("_h.w"), "v": F.col("_h.x")}).drop("_h")


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("lines").alias("dataset"), F.col("o_custkey").alias("ind"), F.col("l_orderkey").alias("grp"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item"),
        F.col("o_orderstatus").alias("status"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return e.select(
        F.floor(F.col("event_id") / CLIP).cast("long").alias("clip"),
        (F.col("event_id") % CLIP).cast("int").alias("frame"), F.col("user_id").alias("grp"),
        F.col("event_type").alias("coeff"), "value")


def waves(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of ``WAVE`` consecutive event values: arrays of bounded length."""
    e = table(spark, sf, "events").select("event_id", "value")
    clip = F.floor(F.col("event_id") / WAVE).cast("long").alias("clip")
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    return e.groupBy(clip).agg(F.transform(ordered, lambda x: x["value"]).alias("samples"))


# Splits ---------------------------------------------------------------------------------------
@query
def group_kfold_assign(spark, sf):
    return rounded(splits.group_folds(identity(spark, sf), BY).select("item", "grp", "fold"))


@query
def group_kfold_customers(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("o").alias("model"), F.col("o_custkey").cast("string").alias("grp"))
    return rounded(splits.group_fold_table(orders, BY).select("grp", "n", "fold"))


@query
def group_rank_folds(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("o").alias("model"), F.col("o_custkey").cast("string").alias("grp"))
    return rounded(splits.group_fold_table(orders, BY, strategy="rank_mod").select("grp", "n", "fold"))


@query
def group_hash_folds(spark, sf):
    lines = order_lines(spark, sf).withColumn("grp", F.col("grp").cast("string"))
    t = splits.group_fold_table(lines, ["dataset"], strategy="hash")
    return rounded(t.groupBy("fold").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_items")))


@query
def stratified_kfold_assign(spark, sf):
    return rounded(splits.stratified_folds(identity(spark, sf), BY).select("item", "ind", "fold"))


@query
def fold_leak_check(spark, sf):
    both = frozen.both_splits(identity(spark, sf), BY)
    return rounded(splits.leak_check(both, ["split"]))


@query
def within_label_split(spark, sf):
    return rounded(splits.within_label_split(identity(spark, sf), BY).select("item", "ind", "is_test"))


@query
def validation_split(spark, sf):
    return rounded(splits.validation_split(identity(spark, sf), BY).select("item", "ind", "is_validation"))


@query
def held_out_sets(spark, sf):
    held = splits.held_out_individuals(identity(spark, sf), BY)
    return rounded(splits.held_out_names(held, BY).select("repeat", "held_out"))


@query
def thinning_eligible(spark, sf):
    return splits.eligible_individuals(identity(spark, sf), BY, THIN).select("ind")


@query
def thinning_samples(spark, sf):
    return rounded(splits.thinned_samples(identity(spark, sf), BY, THIN).select(
        "groups", "items", "draw", "ind", "grp", "item"))


# Identification -------------------------------------------------------------------------------
def _centroid(spark, sf, split):
    return C.centroid_predictions(frozen.with_split(identity(spark, sf), BY, split), BY)


@query
def centroid_by_group(spark, sf):
    return rounded(C.fold_scores(_centroid(spark, sf, "group"), BY).select("fold", "n", "accuracy", "macro_f1"))


@query
def centroid_random(spark, sf):
    return rounded(C.fold_scores(_centroid(spark, sf, "random"), BY).select("fold", "n", "accuracy", "macro_f1"))


@query
def centroid_predictions(spark, sf):
    preds = _centroid(spark, sf, "group").select("fold", "item", "truth", "pred", "score")
    return rounded(long_predictions(preds, model="emb", subset="all"))


@query
def centroid_macro_f1(spark, sf):
    folds = C.fold_scores(_centroid(spark, sf, "group"), BY)
    cols = ["accuracy", "macro_f1", "balanced_accuracy"]
    return rounded(M.over_folds(folds, BY, cols).drop("model"))


@query
def confusion_counts(spark, sf):
    return rounded(M.confusion(_centroid(spark, sf, "group"), BY).drop("model"))


@query
def leakage_delta(spark, sf):
    return rounded(frozen.leakage_delta(identity(spark, sf), BY).drop("model"))


@query
def vote_fusion(spark, sf):
    w = frozen.with_split(windows(spark, sf), BY, "group")
    preds = C.centroid_predictions(w, BY)
    return rounded(M.vote(preds, BY, ["fold", "window"]).select("item", "truth", "pred"))


@query
def fused_scores(spark, sf):
    w = frozen.with_split(windows(spark, sf), BY, "group")
    return rounded(frozen.fused_scores(C.centroid_predictions(w, BY), BY).select("n", "accuracy", "macro_f1"))


@query
def encounter_accuracy(spark, sf):
    preds = C.encounter_predictions(frozen.with_split(identity(spark, sf), BY, "group"), BY)
    return rounded(C.fold_scores(preds, BY).select("fold", "n", "accuracy"))


@query
def nearest_neighbours(spark, sf):
    """Top five other-fold items of every item."""
    f = splits.group_folds(identity(spark, sf), BY).withColumn("v", V.l2("v"))
    return rounded(_neighbours(f).select("fold", "item", "ref", "score", "rank"))


def _fold_refs(f: DataFrame) -> DataFrame:
    folds = F.explode(F.sequence(F.lit(0), F.lit(S.N_FOLDS - 1)))
    return f.withColumn("_f", folds).filter(F.col("_f") != F.col("fold")).select(
        *BY, F.col("_f").alias("fold"), F.col("item").alias("ref"), F.col("ind").alias("pred"), F.col("v").alias("t"))


def _neighbours(f: DataFrame, **options) -> DataFrame:
    return nearest(f.withColumn("truth", F.col("ind")), _fold_refs(f), [*BY, "fold"], ["item", "truth"],
                   ["ref", "pred"], k=S.KNN_K, **options)


@query
def nearest_blocked(spark, sf):
    """The same neighbours with both sides shuffled as strips."""
    f = splits.group_folds(identity(spark, sf), BY).withColumn("v", V.l2("v"))
    return rounded(_neighbours(f, broadcast_rows=0, block_rows=64).select("fold", "item", "ref", "score", "rank"))


@query
def knn_vote(spark, sf):
    f = splits.group_folds(identity(spark, sf), BY).withColumn("v", V.l2("v")).withColumn("truth", F.col("ind"))
    return rounded(C.knn_predictions(f, _fold_refs(f), [*BY, "fold"], ["item", "truth"], ["ref"]).select(
        "fold", "item", "truth", "pred"))


# Verification ---------------------------------------------------------------------------------
@query
def verification_auc(spark, sf):
    return rounded(C.verification(identity(spark, sf), BY).select("n_pos", "n_neg", "auc"))


@query
def verification_blocked(spark, sf):
    """The same pairs over many strips."""
    return rounded(C.verification(identity(spark, sf), BY, block_rows=64).select("n_pos", "n_neg", "auc"))


@query
def verification_eer(spark, sf):
    return rounded(C.verification(identity(spark, sf), ["kind"]).select("kind", "eer"))


# Evaluations ----------------------------------------------------------------------------------
@query
def fold_standardise(spark, sf):
    f = splits.group_folds(identity(spark, sf), BY)
    d = fold_scalers(f, BY).select("fold", F.posexplode(F.arrays_zip("mean", "sd")).alias("dim", "x"))
    return rounded(d.select("fold", "dim", F.col("x.mean").alias("mean"), F.col("x.sd").alias("sd")))


@query
def closed_set_frozen(spark, sf):
    return rounded(learned.closed_set(identity(spark, sf), BY, with_clusters=False).drop("model"))


def _held_out(spark, sf):
    z = learned.held_out_vectors(identity(spark, sf), BY).withColumn("v", F.col("z"))
    return [z.filter(F.col("role") == r) for r in ("known_train", "known_test", "novel")]


@query
def open_set_auroc(spark, sf):
    train, test, novel = _held_out(spark, sf)
    return rounded(C.open_set_scores(train, test, novel, [*BY, "repeat"]).select("repeat", "auc"))


@query
def few_shot_1(spark, sf):
    train, _, novel = _held_out(spark, sf)
    return rounded(C.few_shot_scores(train, novel, [*BY, "repeat"], [1]).select("repeat", "accuracy"))


@query
def few_shot_5(spark, sf):
    train, _, novel = _held_out(spark, sf)
    return rounded(C.few_shot_scores(train, novel, [*BY, "repeat"], [5]).select("repeat", "accuracy"))


@query
def leave_individuals_out_frozen(spark, sf):
    rows = learned.leave_individuals_out(identity(spark, sf), BY, with_clusters=False)
    return rounded(rows.select("repeat", "held_out", "eer", "open_set_auroc", "few_shot_1", "few_shot_5"))


@query
def probe_by_group(spark, sf):
    f = frozen.with_split(identity(spark, sf), BY, "group")
    return rounded(C.fold_scores(probe_predictions(f, BY), BY).drop("model"))


@query
def probe_random(spark, sf):
    f = frozen.with_split(identity(spark, sf), BY, "random")
    return rounded(C.fold_scores(probe_predictions(f, BY), BY).drop("model"))


@query
def probe_models(spark, sf):
    """The model table's shape, and whether each fit ended where the loss is flat."""
    models = probe_fits(frozen.with_split(identity(spark, sf), BY, "group"), BY)
    return rounded(models.select("fold", F.size("classes").alias("n_classes"), "dim", "n_fit", (F.col("gradient") < 1e-5).alias("optimal")))


@query
def probe_ceiling(spark, sf):
    return rounded(learned.probe_ceiling(identity(spark, sf), BY))


@query
def kmeans_scores(spark, sf):
    return rounded(clustering(identity(spark, sf), BY))


@query
def kmeans_assignment(spark, sf):
    """Rows that another cluster's mean is clearly nearer to: none once Lloyd's steps have ended."""
    rows = kmeans_assign(identity(spark, sf), BY).select("item", "cluster", V.l2("v").alias("u"))
    means = rows.groupBy("cluster").agg(V.vector_mean("u").alias("m"))
    every = F.broadcast(means.agg(F.collect_list(F.struct("cluster", "m")).alias("_m")))     # one row of k means
    far = lambda m: F.sqrt(F.aggregate(F.zip_with("u", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    judged = rows.crossJoin(every).select("cluster", F.transform("_m", lambda c: F.struct(c["cluster"].alias("c"), far(c["m"]).alias("d"))).alias("_d"))
    own = F.filter("_d", lambda x: x["c"] == F.col("cluster"))[0]["d"]
    least = F.array_min(F.transform("_d", lambda x: x["d"]))
    return judged.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("n_clusters"), F.count_if(own > least + 1e-3).alias("misassigned"))


@query
def score_frozen(spark, sf):
    row, _ = frozen.score(identity(spark, sf), BY)
    return rounded(row)


def _head(spark, sf, loss):
    z = learned.closed_set_vectors(identity(spark, sf), BY, loss)
    acc = M.accuracy(learned.closed_set_predictions(z, BY, "centroid"), [*BY, "fold"])
    return rounded(acc)


@query
def head_models(spark, sf):
    """The model tables of both losses, and whether training ended below the loss of its first step.

    As its SQL states, these heads are trained on rows drawn by digest; every other query trains on all train rows.
    """
    out = None
    for loss in S.LOSSES:
        rows = fit_sample(learned.closed_set_rows(identity(spark, sf), BY).where("is_train"), [*BY, "fold"], "ind", ["item", "window"],
                          f"head_fit_{loss}", HEAD_ROWS)
        start = head_fits(rows, [*BY, "fold"], loss, max_epochs=1).select("fold", F.col("loss").alias("_start"))
        one = head_fits(rows, [*BY, "fold"], loss).join(start, "fold").select(
            F.lit(loss).alias("loss"), "fold", "n_fit", "dim", (F.col("epochs") <= S.MAX_EPOCHS).alias("within_epochs"),
            (F.col("loss") <= F.col("_start")).alias("better_than_start"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query
def head_proto(spark, sf):
    return _head(spark, sf, "proto")


@query
def head_supcon(spark, sf):
    return _head(spark, sf, "supcon")


def _fold_rows(spark, sf):
    folds = splits.group_folds(identity(spark, sf), BY)
    return folds.join(fold_scalers(folds, BY).withColumnRenamed("fold", "fit"), BY).select(
        "fit", (F.col("fold") != F.col("fit")).alias("is_train"), "item", V.standardise("v", "mean", "sd").alias("x"))


@query
def closed_set_heads(spark, sf):
    """Evaluation A of both heads, clusters included."""
    out = None
    for loss in S.LOSSES:
        one = learned.closed_set(identity(spark, sf), BY, loss, n_init=2)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query
def pca_projection(spark, sf):
    p = principal_components(_fold_rows(spark, sf), ["fit"], 8)
    return rounded(p.groupBy("fit").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")))


@query
def pca_components(spark, sf):
    """Variances of the projected train rows: their total over all components, order, correlations, agreement with the table."""
    rows = _fold_rows(spark, sf)
    models = component_models(rows, ["fit"], 8)
    whole = component_models(rows, ["fit"], 1 << 20).select("fit", F.aggregate("variances", F.lit(0.0), lambda s, x: s + x).alias("total_variance"))
    p = principal_components(rows, ["fit"], 8).where("is_train")
    pairs = F.explode(F.flatten(F.transform("x", lambda a, i: F.transform("x", lambda b, j: F.struct(
        i.alias("i"), j.alias("j"), (a * b).alias("ab"))))))
    second = p.select("fit", pairs.alias("_p")).groupBy("fit", "_p.i", "_p.j").agg((F.sum("_p.ab") / (F.count("*") - 1)).alias("c"), F.count("*").alias("n"))
    stated = models.select("fit", F.posexplode("variances").alias("i", "stated"))
    seen = second.join(stated, ["fit", "i"]).groupBy("fit").agg(
        F.max("n").alias("n_train"), F.countDistinct("i").alias("kept"),
        F.max(F.when(F.col("i") != F.col("j"), F.abs("c")).otherwise(0.0)).alias("_off"),
        F.max(F.when(F.col("i") == F.col("j"), F.abs(F.col("c") - F.col("stated"))).otherwise(0.0)).alias("_miss"),
        F.array_sort(F.collect_list(F.when(F.col("i") == F.col("j"), F.struct("i", "c")))).alias("_d"))
    falling = F.forall(F.sequence(F.lit(1), F.size("_d") - 1), lambda i: F.get("_d", i - 1)["c"] >= F.get("_d", i)["c"] - 1e-9)
    return rounded(seen.join(whole, "fit").select(
        "fit", "n_train", "kept", "total_variance", falling.alias("falling"), (F.col("_off") < 1e-6).alias("uncorrelated"),
        (F.col("_miss") < 1e-6).alias("as_stated")))


@query
def batch_encode(spark, sf):
    def make():
        w = np.random.default_rng(7).normal(size=(64, 16))
        return lambda x: np.asarray(x, dtype=float) @ w

    return encode(identity(spark, sf), make, "projection", dim=64).select("item", "model", F.size("v").alias("dim"), "error")


@query
def encoded_values(spark, sf):
    """Every component of a stated projection, so that its values can be checked."""
    def make():
        j, k = np.meshgrid(np.arange(64), np.arange(16), indexing="ij")
        w = ((16 * j + k) % 7 - 3) / 10.0
        return lambda x: np.asarray(x, dtype=float) @ w

    rows = encode(identity(spark, sf), make, "stated", dim=64).select("item", F.posexplode("v").alias("dim", "value"))
    return rounded(rows)


# Clustering scores on label columns ------------------------------------------------------------
@query
def contingency_counts(spark, sf):
    d = table(spark, sf, "documents")
    return M.contingency(d, [], "lang", "source")


@query
def ari_nmi(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("d").alias("model"), "lang", "source")
    return rounded(M.cluster_scores(M.contingency(d, BY, "lang", "source"), BY).select("ari", "nmi"))


@query
def ami(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("d").alias("model"), "lang", "source")
    return rounded(M.cluster_scores(M.contingency(d, BY, "lang", "source"), BY).select("ami"))


# Diagnostics ----------------------------------------------------------------------------------
@query
def domain_shift_centroid(spark, sf):
    coarse = identity(spark, sf).withColumn("grp", (F.col("item") % 5).cast("string"))
    return rounded(D.domain_shift(coarse, BY).drop("model"))


@query
def domain_shift_mean_lift(spark, sf):
    coarse = identity(spark, sf).withColumn("grp", (F.col("item") % 5).cast("string"))
    return rounded(D.domain_shift(coarse, BY).groupBy("model").agg(
        F.avg("lift_over_chance").alias("mean_lift"), F.count("*").alias("n_individuals")))


@query
def domain_shift_probe(spark, sf):
    coarse = identity(spark, sf).withColumn("grp", (F.col("item") % 5).cast("string"))
    return rounded(D.domain_shift(coarse, BY, "probe").drop("model"))


@query
def within_stratum(spark, sf):
    return rounded(D.within_stratum(identity(spark, sf), BY).drop("model"))


@query
def kinship_permutation(spark, sf):
    means = item_means(identity(spark, sf), [*BY, "item", "ind", "family"])
    return rounded(D.kinship(means, BY).drop("model"))


@query
def split_structure(spark, sf):
    final = F.when(F.col("status") == "F", F.lit("final"))
    tags = F.explode(F.array_compact(F.array(F.lit("all"), final)))
    return rounded(D.split_structure(order_lines(spark, sf).withColumn("subset", tags), ["subset"]))


@query
def thinning_experiment(spark, sf):
    return rounded(D.leakage_experiment(identity(spark, sf), BY, THIN).drop("model"))


@query
def thinning_rank_correlation(spark, sf):
    t = D.leakage_experiment(identity(spark, sf), BY, THIN).withColumn("leakage_delta", F.round("leakage_delta", 9))
    return rounded(D.rank_correlation(t, BY, "items_per_group", "leakage_delta").drop("model"))


@query
def thinning_probe(spark, sf):
    return rounded(D.leakage_experiment(identity(spark, sf), BY, THIN, draws=3, classifier="probe").drop("model"))


@query
def item_set_gain(spark, sf):
    return rounded(D.item_set_gain(identity(spark, sf), BY).drop("model"))


@query
def item_set_gain_probe(spark, sf):
    return rounded(D.item_set_gain(identity(spark, sf), BY, classifier="probe").drop("model"))


@query
def thinning_all_conditions(spark, sf):
    """All four conditions and twelve draws, on eight source groups per individual."""
    coarse = identity(spark, sf).withColumn("grp", (F.col("item") % 8).cast("string"))
    return rounded(D.leakage_experiment(coarse, BY).drop("model"))


# Frames and vectors ---------------------------------------------------------------------------
@query
def group_normalise(spark, sf):
    f = frames(spark, sf)
    return rounded(features.normalise_by_group(f, ["grp"]).select("clip", "frame", "grp", "coeff", "normalised"))


@query
def frame_summary(spark, sf):
    s = features.summarise(frames(spark, sf), ["clip"]).select("clip", F.posexplode("v").alias("dim", "value"))
    return rounded(s)


@query
def frame_delta(spark, sf):
    f = frames(spark, sf).drop("coeff", "grp")
    return rounded(features.deltas(f, ["clip"]).select("clip", "frame", "delta"))


@query
def pad_series(spark, sf):
    w = waves(spark, sf).withColumn("samples", V.pad_to("samples", F.lit(WAVE + 500)))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return rounded(w.select("clip", F.size("samples").alias("n"), F.get("samples", F.lit(0)).alias("head"),
                            F.element_at("samples", -1).alias("tail"), F.round(total, 4).alias("total")))


@query
def mono_mix(spark, sf):
    w = waves(spark, sf).select("clip", V.mono(F.array("samples", F.reverse("samples"))).alias("m"))
    return rounded(w.select("clip", F.posexplode("m").alias("pos", "value")))


@query
def spectral_vectors(spark, sf):
    w = waves(spark, sf).withColumn("grp", (F.col("clip") % 3).cast("string"))
    out = None
    for variant in S.MFCC_VARIANTS:
        one = features.spectral_vectors(w, ["clip"], "grp", variant)
        out = one if out is None else out.unionByName(one)
    return out.select("clip", "model", F.size("v").alias("dim"), V.is_finite("v").alias("finite"))


@query
def spectral_coefficients(spark, sf):
    return rounded(features.spectral_frames(waves(spark, sf), ["clip"], 20))


@query
def spectral_summary(spark, sf):
    """Mean and deviation of every coefficient of the plain variant."""
    w = waves(spark, sf).withColumn("grp", F.lit("g"))
    one = features.spectral_vectors(w, ["clip"], "grp", "mfcc_lakdari")
    return rounded(one.select("clip", F.posexplode("v").alias("dim", "value")))


@query
def item_mean_vectors(spark, sf):
    m = item_means(windows(spark, sf), [*BY, "item"])
    return rounded(m.select("item", F.posexplode("v").alias("dim", "value")))


@query
def unit_vectors(spark, sf):
    u = identity(spark, sf).withColumn("u", V.l2("v"))
    ones = F.transform("v", lambda x: F.lit(1.0))
    return rounded(u.select("item", V.norm("u").alias("length"), V.dot("v", "u").alias("dot"),
                            V.cosine("v", ones).alias("cosine")))


@query
def wide_vector_dump(spark, sf):
    return rounded(wide_vectors(identity(spark, sf).select("item", "v"), 64))


@query
def concat_vectors(spark, sf):
    c = identity(spark, sf).select("item", V.concat_vectors("v", "v").alias("v"))
    return rounded(c.select("item", F.size("v").alias("dim"), F.element_at("v", -1).alias("last")))


# Inventory, quality, lineage -------------------------------------------------------------------
@query
def chance_baselines(spark, sf):
    return rounded(frozen.chance_baselines(identity(spark, sf), BY).drop("model"))


@query
def inventory(spark, sf):
    return rounded(frozen.inventory(windows(spark, sf), ["kind"]))


@query
def size_gates(spark, sf):
    rows = frozen.scorable(identity(spark, sf), ["grp"], min_rows=20, min_individuals=3)
    return rounded(rows.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("ind").alias("n_individuals")))


@query
def describe(spark, sf):
    return rounded(quality.describe(order_lines(spark, sf), ["dataset"]))


@query
def shared_groups(spark, sf):
    return rounded(quality.shared_groups(identity(spark, sf), []).filter("n_individuals > 1"))


@query
def finite_filter(spark, sf):
    """Coordinates divided by a column that is zero for some items: infinite windows drop out."""
    w = windows(spark, sf)
    bad = F.when(F.col("item") % 7 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    w = w.withColumn("v", F.when(F.col("window") == 1, F.transform("v", lambda x: x * bad)).otherwise(F.col("v")))
    ok = V.is_finite("v")
    return rounded(w.groupBy("item").agg(F.count_if(ok).alias("n_finite"), F.every(ok).alias("whole")))


@query
def missing_tokens(spark, sf):
    d = table(spark, sf, "conversations").select("role", F.trim(F.substring_index("text", " ", 1)).alias("word"))
    d = d.withColumn("padded", F.concat(F.lit(" "), F.when(F.length("word") <= 3, "NA").otherwise(F.lower("word")), F.lit(" ")))
    return rounded(d.groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(X.is_missing("padded")).alias("n_missing"),
        F.count(X.missing_to_null("padded")).alias("n_present")))


@query
def missing_values(spark, sf):
    """Missing tokens among whole values: texts as they are, and roles with every seventh turn's blanked out."""
    d = table(spark, sf, "conversations").withColumn("marked", F.when(F.col("turn") % 7 == 3, F.concat(F.lit(" N/A"), F.lit(" "))).otherwise(F.col("role")))
    return rounded(d.groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(X.is_missing("text")).alias("n_missing_text"), F.count_if(X.is_missing("marked")).alias("n_missing_role"),
        F.count(X.missing_to_null("text")).alias("n_present_text")))


@query
def dq_report(spark, sf):
    docs = quality.key_report(table(spark, sf, "documents"), ["doc_id"]).withColumn("source", F.lit("documents"))
    lines = quality.key_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn(
        "source", F.lit("lineitem"))
    return rounded(docs.unionByName(lines))


@query
def duplicate_keys(spark, sf):
    return rounded(quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query
def missing_group_report(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(quality.null_report(d, "quality", "doc_id"))


@query
def problem_report(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "absent").when(F.col("n_chars") < 100, "short").when(
        F.col("toxic") == 1, "toxic").otherwise("ok")
    return rounded(quality.problem_report(d.withColumn("status", status), ["lang"], name="doc_id"))


@query
def resume_pending(spark, sf):
    return rounded(pending(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]))


@query
def completeness(spark, sf):
    expected = table(spark, sf, "documents").select(F.col("doc_id").alias("item"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("item"), "quality", "toxic")
    found = lab.select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("model"), "item").unionByName(
        expected.select(F.lit("full").alias("model"), "item"))
    models = found.select("model").unionByName(
        table(spark, sf, "region").select(F.lit("never").alias("model")))
    return rounded(quality.completeness(expected, found, models))


def _changed_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    hit = F.col("n_chars") % 11 == 0
    other = d.filter(F.col("n_chars") % 13 != 0).withColumns(
        {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")),
         "lang": F.when(F.col("n_chars") % 17 == 0, F.lit(None)).otherwise(F.col("lang"))})
    return d, other


@query
def table_diff(spark, sf):
    left, right = _changed_documents(spark, sf)
    return rounded(diff.table_diff(left, right, ["doc_id"]))


@query
def inventory_diff(spark, sf):
    left, right = _changed_documents(spark, sf)
    cast = lambda d: d.withColumn("n_chars", F.col("n_chars").cast("string"))
    return rounded(diff.inventory_diff(cast(left), cast(right), "doc_id", "n_chars"))


@query
def determinism(spark, sf):
    run = lambda: rounded(C.fold_scores(_centroid(spark, sf, "group"), BY))
    return rounded(diff.determinism(run(), run(), ["fold"]))


@query
def content_digest(spark, sf):
    stamped = lineage.stamp(table(spark, sf, "documents"), "run-1", "e", "c")
    return rounded(lineage.content_digest(stamped, ["lang"]))


@query
def text_digest(spark, sf):
    return rounded(table(spark, sf, "pages").select("page_id", X.text_md5("html").alias("md5"),
                                                    F.sha2("html", 256).alias("sha256")))


@query
def manifest(spark, sf):
    names = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
             "pages": ["page_id", "url", "html"]}
    return rounded(lineage.manifest({n: table(spark, sf, n).select(*c) for n, c in names.items()}))


@query
def package_digest(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("env"), F.col("p_name").alias("name"),
                                        F.col("p_size").cast("string").alias("version"))
    return lineage.package_digest(p, ["env"])


@query
def merkle_digest(spark, sf):
    """Digest of every distinct order line reference per return flag."""
    lines = table(spark, sf, "lineitem")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rounded(lineage.merkle_digest(lines, line, ["l_returnflag"]))


@query
def lineage_gate(spark, sf):
    env = F.when(F.col("ind").isin("3", "7"), "env-b").otherwise("env-a")
    sets = identity(spark, sf).withColumns({"env_hash": env, "config_hash": F.lit("cfg")})
    agree = lineage.feature_agreement(sets, ["stratum"])
    foreign = lineage.foreign_rows(sets, "env-a", "cfg").groupBy("stratum").agg(F.count("*").alias("n_foreign"))
    return rounded(agree.join(foreign, "stratum", "left").na.fill(0, ["n_foreign"]))


@query
def claim_checks(spark, sf):
    seen = frozen.inventory(identity(spark, sf), BY)
    claims = table(spark, sf, "embeddings").agg(
        F.count("*").cast("double").alias("a"), F.countDistinct("label").cast("double").alias("b"))
    rows = F.array(
        F.struct(F.lit("n_items").alias("check"), F.col("a").alias("expected"), F.lit(0.0).alias("tolerance")),
        F.struct(F.lit("n_individuals").alias("check"), (F.col("b") + 1).alias("expected"), F.lit(0.0).alias("tolerance")),
        F.struct(F.lit("dim").alias("check"), F.lit(60.0).alias("expected"), F.lit(5.0).alias("tolerance")),
        F.struct(F.lit("absent_figure").alias("check"), F.lit(1.0).alias("expected"), F.lit(0.0).alias("tolerance")))
    claims = claims.select(F.lit("emb").alias("model"), F.explode(rows).alias("r")).select("model", "r.*")
    return rounded(quality.expectation_report(seen, BY, claims).drop("model"))


@query
def subset_filter(spark, sf):
    rows = subset(table(spark, sf, "orders"), {"o_orderstatus": "F"})
    return rounded(rows.groupBy("o_orderpriority").agg(F.count("*").alias("n")))


@query
def group_minimum_size(spark, sf):
    lines = order_lines(spark, sf).withColumn("model", F.lit("lines"))
    rows = D.usable_groups(lines, BY, min_items=5, min_groups=3, min_total=24)
    return rounded(rows.groupBy("ind").agg(F.count("*").alias("n_items"), F.countDistinct("grp").alias("n_groups")))


@query
def human_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.human_size(F.col("n_chars") * 997).alias("size"))


@query
def json_field(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(
        F.count(k).alias("n"), F.sum(k).alias("total")))


@query
def deduplicate_first(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return rounded(quality.deduplicate(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_returnflag"]))
