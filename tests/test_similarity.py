import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.functions.vectors import l2
from likeness.operators import classify, metrics, similarity
from likeness.operators.splits import group_folds

BY = ["model"]


def vectors(df):
    rows = sorted(df.collect(), key=lambda r: r.item)
    v = np.array([r.v for r in rows])
    return rows, v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "block_rows": 17}])
def test_nearest_matches_brute_force(people, options):
    u = people.withColumn("v", l2("v"))
    refs = u.select("model", F.col("item").alias("ref"), F.col("v").alias("t"))
    got = similarity.nearest(u, refs, BY, ["item"], ["ref"], k=3, **options).collect()
    rows, m = vectors(people)
    s = np.round(m @ m.T, 9)
    for r in got:
        order = np.lexsort((np.arange(len(rows)), -s[r.item]))
        assert rows[order[r["rank"] - 1]].item == r.ref
        assert r.score == pytest.approx(s[r.item][r.ref], abs=1e-9)
    assert len(got) == 3 * len(rows)


def test_fewer_references_than_k(people):
    refs = people.limit(2).select("model", F.col("item").alias("ref"), l2("v").alias("t"))
    got = similarity.nearest(people.withColumn("v", l2("v")), refs, BY, ["item"], ["ref"], k=5)
    assert got.count() == 2 * people.count()


@pytest.mark.parametrize("block_rows", [4096, 13])
def test_pair_histogram_matches_all_pairs(people, block_rows):
    got = {(r.bin): (r.pos, r.neg) for r in similarity.pair_histogram(people, BY, block_rows=block_rows).collect()}
    rows, m = vectors(people)
    want = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            same, group = rows[i].ind == rows[j].ind, rows[i].grp == rows[j].grp
            if same and group:
                continue
            b = int(np.rint(np.clip(m[i] @ m[j], -1, 1) * 10**6))
            p, n = want.get(b, (0, 0))
            want[b] = (p + same, n + (not same))
    assert got == want


def hist(spark, pairs):
    rows = [("m", float(s), bool(p)) for s, p in pairs]
    df = spark.createDataFrame(rows, "model string, s double, p boolean")
    return metrics.auc_eer(similarity.score_histogram(df, BY, "s", F.col("p")), BY).first()


def roc_reference(pairs):
    """AUC by comparing all pairs; EER from an explicit vertex list."""
    pos = [s for s, p in pairs if p]
    neg = [s for s, p in pairs if not p]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    cuts = sorted({s for s, _ in pairs}, reverse=True)
    pts = [(sum(s >= c for s in neg), sum(s >= c for s in pos)) for c in cuts]
    keep = [p for i, p in enumerate(pts) if i in (0, len(pts) - 1) or
            (pts[i + 1][0] - p[0], pts[i + 1][1] - p[1]) != (p[0] - pts[i - 1][0], p[1] - pts[i - 1][1])]
    keep = [(0, 0)] + keep
    gaps = [abs((1 - t / len(pos)) - f / len(neg)) for f, t in keep]
    return auc, keep[int(np.argmin(gaps))][0] / len(neg)


def test_auc_of_ties_is_half(spark):
    assert hist(spark, [(0.5, True), (0.5, False)]).auc == 0.5


def test_perfect_scores(spark):
    r = hist(spark, [(0.9, True), (0.8, True), (0.1, False), (0.2, False)])
    assert (r.auc, r.eer) == (1.0, 0.0)


def test_one_sided_is_null(spark):
    r = hist(spark, [(0.1, False), (0.2, False)])
    assert r.auc is None and r.eer is None


@pytest.mark.parametrize("seed", range(4))
def test_auc_and_eer_match_reference(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(round(float(rng.normal(0.3 * p, 0.5)), 1) / 10, bool(p)) for p in rng.integers(0, 2, 60)]
    r = hist(spark, pairs)
    auc, eer = roc_reference(pairs)
    assert r.auc == pytest.approx(auc) and r.eer == pytest.approx(eer)
    flipped = hist(spark, [(-s, p) for s, p in pairs])
    assert flipped.auc == pytest.approx(1 - auc)


def test_centroid_beats_chance_and_blocks_agree(people):
    f = group_folds(people, BY)
    a = classify.centroid_predictions(f, BY)
    b = classify.centroid_predictions(f, BY, broadcast_rows=0, block_rows=16)
    assert {(r.item, r.pred) for r in a.collect()} == {(r.item, r.pred) for r in b.collect()}
    acc = classify.fold_scores(a, BY).agg(F.avg("accuracy")).first()[0]
    assert acc > 0.8


def test_leave_fold_out_templates(people):
    """The subtraction form equals a mean over the train rows."""
    from likeness.operators.templates import fold_sums, fold_templates

    f = group_folds(people, BY).persist()
    got = {(r.fold, r.ind): np.array(r.t) for r in fold_templates(fold_sums(f, BY), BY).collect()}
    rows = f.collect()
    for (fold, ind), t in got.items():
        m = np.array([np.array(r.v) / np.linalg.norm(r.v) for r in rows if r.fold != fold and r.ind == ind]).mean(0)
        assert np.allclose(t, m / np.linalg.norm(m))


def test_missing_individual_skips_or_drops(spark, people):
    lonely = people.limit(3).select(
        "model", (F.col("item") + 1000).alias("item"), "window", F.lit("solo").alias("ind"), F.lit("gs").alias("grp"),
        "stratum", "family", "kind", "v")
    f = group_folds(people.unionByName(lonely), BY).persist()
    fold = f.filter("ind = 'solo'").first().fold
    skipped = classify.centroid_predictions(f, BY, enrolment="all")
    assert skipped.filter(F.col("fold") == fold).count() == 0
    dropped = classify.centroid_predictions(f, BY, enrolment="rows")
    assert dropped.filter("truth = 'solo'").count() == 0 and dropped.filter(F.col("fold") == fold).count() > 0
