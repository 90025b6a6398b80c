import pytest
from pyspark.sql import functions as F

from likeness.operators import diff, lineage, quality
from likeness.plans import run as R
from likeness.sources.sinks import append_rows


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, s string")


def test_digest_ignores_order_and_stamps_but_not_content(spark, rows):
    d = lambda df: lineage.content_digest(df).first().digest
    base = d(rows)
    assert d(rows.orderBy(F.desc("k")).repartition(3)) == base
    assert d(lineage.stamp(rows, "r", "e", "c")) == base
    assert d(rows.distinct()) != base
    assert d(rows.withColumn("s", F.when(F.col("k") == 1, None).otherwise(F.col("s")))) != base


def test_append_is_gated(rows, tmp_path):
    path = str(tmp_path / "t")
    one = lineage.stamp(rows, "r1", "e1", "c1")
    append_rows(one, path, expected=("e1", "c1"))
    append_rows(one, path, expected=("e1", "c1"))
    assert rows.sparkSession.read.parquet(path).count() == 6
    with pytest.raises(lineage.LineageError):
        append_rows(lineage.stamp(rows, "r2", "e2", "c1"), path, expected=("e2", "c1"))
    with pytest.raises(lineage.LineageError):
        lineage.check_table(rows, "e1", "c1")


def test_features_must_agree(spark):
    p = spark.createDataFrame([("m", "a", "e1", "c"), ("m", "b", "e1", "c")], "d string, f string, env_hash string, config_hash string")
    assert lineage.check_features(p) == "e1" and lineage.feature_agreement(p, ["d"]).first().agree
    with pytest.raises(lineage.LineageError):
        lineage.check_features(p, "other")
    with pytest.raises(lineage.LineageError):
        lineage.check_features(p.withColumn("env_hash", F.col("f")))
    assert not lineage.feature_agreement(p.withColumn("env_hash", F.lit(None).cast("string")), ["d"]).first().agree


def test_diff_of_equal_tables_is_empty(rows):
    one = rows.distinct()
    assert diff.table_diff(one, lineage.stamp(one, "r", "e", "c"), ["k"]).count() == 0
    assert diff.determinism(one, one, ["k"]).first().outcome == "pass"
    assert diff.same_content(rows, rows.orderBy("k")) and not diff.same_content(rows, one)


def test_diff_names_the_first_difference(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0)], "k int, s string, d double")
    b = spark.createDataFrame([(1, "x", 1.5), (2, "y", 2.0), (4, "w", 3.0)], "k int, s string, d double")
    got = {r.column: r for r in diff.table_diff(a, b, ["k"]).collect()}
    assert got["d"].n_different == 2 and (got["d"].left_value, got["d"].right_value) == ("1.0", "1.5")
    assert got["__row__"].n_different == 2 and got["__row__"].first_key == "3" and "s" not in got
    with pytest.raises(ValueError):
        diff.table_diff(a, b.drop("s"), ["k"])


def test_quality_reports(spark):
    found = spark.createDataFrame([("a", "ok", "1"), ("b", "empty", "2"), ("c", "ok", "3")], "path string, status string, md5 string")
    items = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    sums = spark.createDataFrame([("a", "1"), ("c", "x")], "path string, md5 string")
    status = quality.file_status(items, found, sums)
    assert {r.path: r.status for r in status.collect()} == {"a": "ok", "b": "empty", "c": "changed", "d": "absent"}
    assert {r.status: (r.n, r.first) for r in quality.problem_report(status, []).collect()} == {
        "empty": (1, "b"), "changed": (1, "c"), "absent": (1, "d")}
    first = quality.deduplicate(spark.createDataFrame([(1, 5, "b"), (1, 3, "a")], "k int, o int, s string"), ["k"], ["o"])
    assert first.first().s == "a"


def test_completeness_names_what_is_missing(spark):
    expected = spark.createDataFrame([(i,) for i in range(6)], "item int")
    found = spark.createDataFrame([("full", i) for i in range(6)] + [("half", 5), ("half", 99)], "model string, item int")
    models = spark.createDataFrame([("full",), ("half",), ("never",)], "model string")
    got = {r.model: (r.n_found, r.n_missing, r.first_missing, r.status)
           for r in quality.completeness(expected, found, models).collect()}
    assert got == {"full": (6, 0, None, "complete"), "half": (1, 5, "0,1,2", "incomplete"), "never": (0, 6, None, "none")}


def test_score_resumes_and_stamps(people, tmp_path):
    run = R.Run("r1", "e1", "c1")
    cells = R.with_cells(people, "set", {"all": None, "s0": {"stratum": "s0"}})
    path = str(tmp_path / "scores")
    only = cells.filter("subset = 'all'")
    assert R.score(only, path, run, n_init=1).count() == 1
    assert R.score(only, path, run, n_init=1) is None
    stored = people.sparkSession.read.parquet(path)
    assert stored.count() == 1 and stored.first().run_id == "r1"
    assert cells.groupBy("subset").count().count() == 2
    with pytest.raises(lineage.LineageError):
        R.score(cells, path, R.Run("r2", "e2", "c1"), n_init=1)
    assert R.finish(people.sparkSession, {"scores": path}, str(tmp_path / "manifest")).first().n_rows == 1


def test_diagnose_writes_its_tables(people, tmp_path):
    rows = people.withColumn("dataset", F.lit("d"))
    R.diagnose(rows, str(tmp_path), R.Run("r", "e", "c"), classifier="centroid")
    read = people.sparkSession.read.parquet
    assert read(str(tmp_path / "split_structure")).first().n_items == 120
    assert read(str(tmp_path / "kinship")).columns[0] == "dataset"


def test_validate_lists_problems(spark):
    from likeness.settings import REQUIRED_COLUMNS

    base = {c: "x" for c in REQUIRED_COLUMNS} | {"kind": "single"}
    rows = [base | {"original_stem": s, "recording_id": r} for s, r in [("a", "r1"), ("a", "r1"), ("b", None)]]
    master = spark.createDataFrame([tuple(r[c] for c in REQUIRED_COLUMNS) for r in rows],
                                   ", ".join(f"{c} string" for c in REQUIRED_COLUMNS))
    expected = spark.createDataFrame([("clips", 3), ("recordings", 5)], "check string, expected int")
    got = {r.check: (r.n, r.first) for r in R.validate(master, expected).collect()}
    assert got == {"expected recordings": (1, "5.0"), "duplicate key": (1, "a"), "no group": (1, "b")}
    with pytest.raises(ValueError, match="kind"):
        R.validate(master.drop("kind"), expected)
