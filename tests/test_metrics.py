import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import metrics as M

BY = ["model"]


def scores(spark, pairs):
    df = spark.createDataFrame([("m", t, p) for t, p in pairs], "model string, truth string, pred string")
    return M.classification_scores(df, BY).first()


def test_macro_f1_counts_a_class_that_is_only_predicted(spark):
    r = scores(spark, [("a", "a"), ("a", "c")])
    assert r.macro_f1 == pytest.approx(1 / 3) and r.accuracy == 0.5 and r.balanced_accuracy == 0.5


def test_vote_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame(
        [("m", 1, 0, "b", "b"), ("m", 1, 1, "b", "a")], "model string, item long, window int, truth string, pred string")
    assert M.vote(df, BY, ["window"]).first().pred == "b"


def clusters(spark, a, b):
    df = spark.createDataFrame([("m", str(x), str(y)) for x, y in zip(a, b)], "model string, a string, b string")
    return M.cluster_scores(M.contingency(df, BY, "a", "b"), BY).first()


def ami_reference(a, b):
    n = len(a)
    ca = [sum(x == v for x in a) for v in sorted(set(a))]
    cb = [sum(x == v for x in b) for v in sorted(set(b))]
    mi = 0.0
    for u in set(a):
        for v in set(b):
            k = sum(x == u and y == v for x, y in zip(a, b))
            if k:
                mi += k / n * math.log(n * k / (a.count(u) * b.count(v)))
    emi = 0.0
    for x in ca:
        for y in cb:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
                emi += p * k / n * math.log(n * k / (x * y))
    h = lambda c: -sum(i / n * math.log(i / n) for i in c)
    return (mi - emi) / ((h(ca) + h(cb)) / 2 - emi)


def test_identical_labels(spark):
    r = clusters(spark, [0, 0, 1, 1, 2], [0, 0, 1, 1, 2])
    assert (r.ari, round(r.nmi, 12), round(r.ami, 12)) == (1.0, 1.0, 1.0)


def test_one_cluster_against_singletons(spark):
    r = clusters(spark, [0] * 5, [0, 1, 2, 3, 4])
    assert r.ari == 0.0 and r.nmi == 0.0


def test_renaming_labels_changes_nothing(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 50).tolist(), rng.integers(0, 3, 50).tolist()
    one, two = clusters(spark, a, b), clusters(spark, [9 - x for x in a], [7 * x + 1 for x in b])
    for k in ("ari", "nmi", "ami"):
        assert one[k] == pytest.approx(two[k], abs=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_ami_matches_direct_sum(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 4, 60).tolist()
    b = [x if rng.random() < 0.4 else int(rng.integers(0, 5)) for x in a]
    assert clusters(spark, a, b).ami == pytest.approx(ami_reference(a, b), abs=1e-10)


def test_expected_information_of_huge_margins():
    import pandas as pd

    a, b, n = 4e11, 3e11, 1e12
    got = M._expected_information(pd.Series([a]), pd.Series([b]), pd.Series([n]))[0]
    mean = a * b / n
    # Second-order expansion around the mean of the hypergeometric distribution.
    var = mean * (n - a) * (n - b) / (n * (n - 1))
    assert got == pytest.approx(var / mean / n / 2, rel=0.05)


def test_over_folds_ignores_nan(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", float("nan"))], "model string, x double")
    r = M.over_folds(df, BY, ["x"]).first()
    assert (r.x, r.x_sd) == (2.0, 1.0)
