import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import head
from likeness.operators.cluster import clustering, kmeans_assign
from likeness.operators.models import fit_sample
from likeness.operators.probe import probe_models, probe_predictions
from likeness.operators.splits import group_folds
from likeness.plans import frozen, learned

BY = ["model"]


def test_probe_scores_every_test_row_from_the_table(people):
    f = group_folds(people, BY).persist()
    whole = {(r.fold, r.item): r for r in probe_predictions(f, BY).collect()}
    assert len(whole) == f.count()
    assert np.mean([r.truth == r.pred for r in whole.values()]) > 0.8
    # The table applied by hand gives the same labels.
    models = {r.fold: r for r in probe_models(f, BY).collect()}
    for r in f.collect():
        m = models[r.fold]
        w = np.reshape(m.w, (m.dim + 1, -1))
        assert whole[r.fold, r.item].pred == m.classes[int((np.array(r.v) @ w[:-1] + w[-1]).argmax())]
    assert all(m.n_fit == m.n_train == f.where(f"fold <> {k}").count() and m.gradient < 1e-5 for k, m in models.items())


def test_a_bounded_fit_still_scores_all_rows(people):
    f = group_folds(people, BY).persist()
    models = probe_models(f, BY, fit_rows=60).collect()
    assert all(m.n_fit <= 110 for m in models)
    with_bound = probe_predictions(f, BY, fit_rows=60)
    assert with_bound.count() == f.count()


def test_fit_sample_is_bounded_and_keeps_rare_classes(spark):
    rows = spark.range(40_000).select(F.lit("m").alias("model"), F.col("id").alias("item"),
                                      F.when(F.col("id") < 30, "rare").otherwise((F.col("id") % 3).cast("string")).alias("ind"))
    kept = fit_sample(rows, BY, "ind", ["item"], "test", 3000).groupBy("ind").agg(
        F.count("*").alias("n"), F.sum("_weight").alias("w")).collect()
    n = {r.ind: r.n for r in kept}
    assert n["rare"] == 30 and sum(n.values()) < 3300
    assert sum(r.w for r in kept) == pytest.approx(40_000, rel=0.05)
    assert fit_sample(rows, BY, "ind", ["item"], "test", 40_000).where("_weight = 1").count() == 40_000


def test_softmax_gradient_is_zero_at_the_optimum():
    from likeness.operators.probe import _fit_softmax

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 5)), rng.integers(0, 3, 80)
    w = _fit_softmax(x, y, 3, 1.0, 500)
    xb = np.hstack([x, np.ones((80, 1))])
    s = np.exp(xb @ w)
    p = s / s.sum(1, keepdims=True)
    g = xb.T @ (p - np.eye(3)[y])
    g[:-1] += w[:-1]
    assert np.abs(g).max() < 1e-3


@pytest.mark.parametrize("loss", ["proto", "supcon"])
def test_head_gradients_match_finite_differences(loss):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(14, 5)), np.repeat([0, 1, 2], 5)[:14]
    w = rng.normal(size=(6, 4)) * 0.5
    support = np.arange(14) % 2 == 0

    def f(w, gradient=False):
        if loss == "supcon":
            return head._supcon_loss(x, y, w, gradient)
        return head._proto_loss(x, y, support, w, 3, gradient)

    g = f(w, True)[1]
    for i, j in [(0, 0), (3, 2), (5, 1)]:
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        assert (f(w + d)[0] - f(w - d)[0]) / 2e-6 == pytest.approx(g[i, j], rel=1e-4, abs=1e-7)


def test_supcon_loss_does_not_depend_on_the_chunk():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(37, 6)), rng.integers(0, 5, 37), rng.normal(size=(7, 4))
    one, many = head._supcon_loss(x, y, w, True), head._supcon_loss(x, y, w, True, chunk=5)
    assert one[0] == pytest.approx(many[0]) and np.allclose(one[1], many[1])


@pytest.mark.parametrize("loss", ["proto", "supcon"])
def test_heads_are_rows_and_project_all_rows(people, loss):
    rows = people.withColumn("is_train", F.col("item") % 5 != 0).withColumn("x", F.col("v"))
    models = head.head_models(rows, BY, loss, max_epochs=3)
    m = models.first()
    w = np.reshape(m.w, (m.dim + 1, -1))
    assert (m.epochs, m.n_fit) == (3, rows.where("is_train").count())
    got = head.head_vectors(rows, BY, loss, max_epochs=3).collect()
    assert len(got) == rows.count()
    x = {r.item: np.array(r.x) for r in rows.collect()}
    for r in got:
        z = x[r.item] @ w[:-1] + w[-1]
        assert np.allclose(r.z, z / np.linalg.norm(z))
    assert head.head_models(rows, BY, loss, max_epochs=1, fit_rows=40).first().n_fit < 100


def test_head_separates(people):
    z = learned.closed_set_vectors(people, BY, "supcon", max_epochs=30).persist()
    p = learned.closed_set_predictions(z, BY, "centroid")
    assert p.agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0] > 0.8


def test_kmeans_finds_separable_people(spark):
    rows = [("m", i, 0, f"p{i % 3}", f"g{i % 7}", [float(i % 3 == k) * 5 + 0.01 * (i % 5) for k in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, item long, window int, ind string, grp string, v array<double>")
    r = clustering(df, BY, n_init=3).first()
    assert r.cluster_ari == 1.0 and r.cluster_nmi == pytest.approx(1.0)
    assert r.cluster_ari_recording < 0.5
    assert kmeans_assign(df, BY, n_init=1).count() == 60


def test_score_row_is_complete(people):
    row, preds = frozen.score(people, BY, n_init=1)
    r = row.first().asDict()
    assert len(r) == 26 and all(v is not None for v in r.values())
    assert r["accuracy_leakage_delta"] == pytest.approx(r["accuracy_random"] - r["accuracy_group"])
    assert 0 <= r["verification_auc"] <= 1 and r["chance_majority_class"] >= r["chance_inverse_n_individuals"]
    assert preds.count() == people.count()


def test_leave_individuals_out_on_few_people(people):
    rows = learned.leave_individuals_out(people, BY, with_clusters=False, shots=[1, 40]).collect()
    assert len(rows) == 12
    assert all(r.few_shot_40 is None and r.few_shot_1 is not None for r in rows)
    assert all(len(r.held_out.split("|")) == 3 for r in rows)


def test_probe_fits_all_rows_in_passes_as_it_does_in_one_task(people):
    f = group_folds(people, BY).persist()
    one = {r.fold: r for r in probe_models(f, BY).collect()}
    many = {r.fold: r for r in probe_models(f, BY, fit_rows=60).collect()}
    assert one.keys() == many.keys()
    for k, m in many.items():
        assert m.n_fit == m.n_train == f.where(f"fold <> {k}").count() and m.classes == one[k].classes and m.gradient < 1e-5
        assert np.allclose(m.w, one[k].w, atol=1e-3)


@pytest.mark.parametrize("loss", ["proto", "supcon"])
def test_heads_are_trained_on_all_rows_in_passes_as_in_one_task(people, loss, monkeypatch):
    monkeypatch.setattr(head, "CHUNK_ROWS", 16)         # several strips of rows
    rows = people.withColumn("is_train", F.col("item") % 5 != 0).withColumn("x", F.col("v"))
    one = head.head_models(rows, BY, loss, max_epochs=4).first()
    many = head.head_models(rows, BY, loss, max_epochs=4, fit_rows=40).first()
    assert (many.n_fit, many.n_train, many.epochs) == (one.n_fit, one.n_train, 4) == (96, 96.0, 4)
    assert many.loss == pytest.approx(one.loss, rel=1e-7) and np.allclose(many.w, one.w, atol=1e-6)
