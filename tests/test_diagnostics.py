import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import diagnostics as D

BY = ["model"]


def exposure(spark, sizes):
    rows = [("m", f"p{g % 2}", f"g{g}") for g, n in enumerate(sizes) for _ in range(n)]
    return D.split_structure(spark.createDataFrame(rows, "model string, ind string, grp string"), BY).first()


def test_singletons_have_no_siblings(spark):
    r = exposure(spark, [1, 1, 1])
    assert r.expected_siblings_in_train == 0 and r.p_any_sibling_in_train == 0 and r.pct_items_with_no_sibling == 100


def test_one_group_of_six(spark):
    r = exposure(spark, [6])
    assert r.expected_siblings_in_train == pytest.approx(4.0)
    assert r.p_any_sibling_in_train == pytest.approx(1 - 0.2**5)


def test_kinship_equals_all_pairs(people):
    r = D.kinship(people, BY, permutations=50).first()
    rows = people.collect()
    names = sorted({x.ind for x in rows})
    t = np.array([np.mean([x.v for x in rows if x.ind == n], axis=0) for n in names])
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    fam = [next(x.family for x in rows if x.ind == n) for n in names]
    same = [t[i] @ t[j] for i in range(4) for j in range(i + 1, 4) if fam[i] == fam[j]]
    other = [t[i] @ t[j] for i in range(4) for j in range(i + 1, 4) if fam[i] != fam[j]]
    assert r.same_family_similarity == pytest.approx(np.mean(same))
    assert r.different_family_similarity == pytest.approx(np.mean(other))
    assert (r.n_same_family_pairs, r.n_different_family_pairs) == (2, 4)
    assert 1 / 51 <= r.p_permutation <= 1


def test_kinship_extreme_gap(spark):
    """Two tight families of four: no shuffle reaches the gap unless it is the same partition."""
    rows = [("m", f"p{i}", f"f{i // 4}", [1.0, 0.01 * i] if i < 4 else [0.01 * i, 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "model string, ind string, family string, v array<double>")
    r = D.kinship(df, BY, permutations=200).first()
    assert r.gap > 0.8 and r.p_permutation < 0.1
    unknown = df.withColumn("family", F.when(F.col("ind") == "p0", None).when(F.col("ind") == "p1", "none").otherwise(F.col("family")))
    assert D.kinship(unknown, BY, permutations=5).first().n_individuals == 6


def test_domain_shift_sees_group_signature(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(2):
        for g in range(3):
            c = rng.normal(size=6) * 3
            rows += [("m", p * 100 + g * 10 + i, 0, f"p{p}", f"{p}{g}", (c + rng.normal(size=6)).tolist()) for i in range(6)]
    rows += [("m", 999, 0, "p9", "x", [0.0] * 6)]
    df = spark.createDataFrame(rows, "model string, item long, window int, ind string, grp string, v array<double>")
    for classifier in ("centroid", "probe"):
        got = D.domain_shift(df, BY, classifier).collect()
        assert sorted(r.ind for r in got) == ["p0", "p1"] and all(r.lift_over_chance > 2 and r.n_items == 18 for r in got)


def test_strata_have_their_own_chance(people):
    got = {r.stratum: r for r in D.within_stratum(people, BY).collect()}
    assert set(got) == {"__pooled__", "s0", "s1", "s2"}
    assert got["__pooled__"].n_items == 120 and all(r.chance == 0.25 and r.lift_over_chance > 2 for r in got.values())


def test_leakage_experiment_needs_enough_people(people):
    assert D.leakage_experiment(people, BY, [(3, 2)], draws=2, min_eligible=5).count() == 0
    r = D.leakage_experiment(people, BY, [(3, 2)], draws=2).first()
    assert r.n_draws == 2 and r.items_per_individual == 6 and r.n_individuals == 4


def test_spearman(spark):
    df = spark.createDataFrame([("m", float(x), float(x * x)) for x in range(5)], "model string, x double, y double")
    assert D.rank_correlation(df, BY, "x", "y").first().spearman == pytest.approx(1.0)


def test_item_set_gain_columns(people):
    rows = people.withColumn("kind", F.when(F.col("item") % 3 == 0, "repeated").otherwise("single"))
    r = D.item_set_gain(rows, BY).first()
    assert r.base_n_items == 80 and r.all_n_items == 120 and r.gain == pytest.approx(r.all_accuracy - r.base_accuracy)


def test_encode_skips_done_rows(people):
    from likeness.operators.inference import encode

    def make():
        return lambda x: x[:, :2] * 2

    first = encode(people, make, "double", dim=8).persist()
    assert first.count() == 120 and len(first.first().v) == 2
    assert encode(people, make, "double", dim=8, done=first.filter("item < 100")).count() == 20
