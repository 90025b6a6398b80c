import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness import settings as S
from likeness.functions import text as X
from likeness.functions import vectors as V
from likeness.operators import features


def ramp(spark, n, slope=1.0, item="a"):
    return spark.createDataFrame([(item, i, slope * i) for i in range(n)], "item string, frame int, value double")


@pytest.mark.parametrize("n", [6, 8, 9, 21])
def test_delta_of_a_ramp_is_its_slope(spark, n):
    d = features.deltas(ramp(spark, n), ["item"]).collect()
    assert len(d) == n and all(r.delta == pytest.approx(1.0) for r in d)


@pytest.mark.parametrize("n", [6, 7, 12, 30])
def test_delta_matches_local_regression(spark, n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "item string, frame int, value double")
    got = {r.frame: r.delta for r in features.deltas(df, ["item"]).collect()}
    half = min(9, max(3, (n // 2) * 2 - 1)) // 2
    for i in range(n):
        c = min(max(i, half), n - 1 - half)
        want = np.polyfit(np.arange(c - half, c + half + 1), y[c - half:c + half + 1], 1)[0]
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_constant_coefficient_normalises_to_zero(spark):
    df = spark.createDataFrame([("g", "a", i, 0, 5.0) for i in range(4)] + [("g", "b", 0, 1, float(i)) for i in range(3)],
                               "grp string, item string, frame int, coeff int, value double")
    rows = features.normalise_by_group(df, ["grp"]).collect()
    assert all(r.normalised == 0 for r in rows if r.coeff == 0)
    assert np.mean([r.normalised for r in rows if r.coeff == 1]) == pytest.approx(0)


def test_summary_is_means_then_deviations(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 3.0), ("a", 0, 1, 5.0), ("a", 1, 1, 5.0)],
                               "item string, frame int, coeff int, value double")
    assert features.summarise(df, ["item"]).first().v == [2.0, 5.0, 1.0, 0.0]


def test_spectral_dimensions_and_tone(spark):
    t = np.arange(8000) / S.SAMPLE_RATE
    clips = spark.createDataFrame(
        [(1, "g", np.sin(2 * np.pi * 1000 * t).tolist()), (2, "g", np.sin(2 * np.pi * 4000 * t).tolist()), (3, "g", [0.1] * 10)],
        "item int, grp string, samples array<double>")
    frames = features.spectral_frames(clips, ["item"], 12)
    counts = {r.item: r.n for r in frames.filter("coeff = 0").groupBy("item").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 51, 2: 51, 3: 6}
    for name, dim in [("mfcc_lakdari", 24), ("mfcc_full", 80), ("mfcc_cmvn", 80)]:
        rows = features.spectral_vectors(clips, ["item"], "grp", name).collect()
        assert {len(r.v) for r in rows} == {dim} and np.isfinite([r.v for r in rows]).all()


def test_mel_filters_have_unit_area():
    m = features._mel_filters(16000, 2048, 40, 500.0, 8000.0)
    assert m.shape == (40, 1025)
    assert np.allclose(m.sum(axis=1) * 16000 / 2048, 1, atol=0.15)


def test_pad_keeps_the_prefix(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0] * 6,)], "v array<double>")
    got = [r.p for r in df.select(V.pad_to("v", F.lit(5)).alias("p")).collect()]
    assert got == [[1.0, 2.0, 3.0, 0.0, 0.0], [1.0] * 6]


def test_missing_tokens(spark):
    values = [" NA ", "", "none", None, "nan", "unknown", "N/A", "x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.m for r in df.orderBy("i").select(X.missing_to_null("s").alias("m")).collect()]
    assert got == [None, None, "none", None, None, "unknown", None, "x"]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.l2("a").alias("u"), V.l2("z").alias("z"), V.dot("a", "a").alias("d"), V.cosine("a", "z").alias("c"),
                  V.concat_vectors("a", "z").alias("k"), V.mono(F.array("a", "z")).alias("m")).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.d == 25 and r.c == 0 and r.m == [1.5, 2.0] and len(r.k) == 4
    V.register_sql_functions(spark)
    s = spark.sql("SELECT vec_dot(array(3D, 4D), array(1D, 1D)) d, vec_l2(array(3D, 4D)) u, vec_cosine(array(1D, 0D), array(0D, 2D)) c").first()
    assert s.d == 7 and s.u == [0.6, 0.8] and s.c == 0


def test_human_size(spark):
    df = spark.createDataFrame([(0, 12), (1, 1536), (2, 3 * 1024**2), (3, 5 * 1024**4)], "i int, b long")
    got = [r.s for r in df.orderBy("i").select(X.human_size("b").alias("s")).collect()]
    assert got == ["12 B", "1.5 KB", "3.0 MB", "5120.0 GB"]


def test_zero_variance_columns_keep_scale_one(spark):
    from likeness.operators.templates import fold_scalers

    rows = [("m", i % 3, [0.1, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "model string, fold int, v array<double>")
    for r in fold_scalers(df, ["model"]).collect():
        x = np.array([v for _, f, v in rows if f != r.fold])
        assert r.sd[0] == 0 and r.sd[1] == pytest.approx(x[:, 1].std()) and np.allclose(r.mean, x.mean(0))
