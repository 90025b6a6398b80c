"""Versions are published whole or not at all, and never across lineages."""

import pytest
from pyspark.sql import functions as F

from likeness.operators.lineage import LineageError
from likeness.plans import run as stages
from likeness.sources import versioned
from likeness.sources.files import folder_digest
from likeness.sources.versioned import ConflictError, commit, expire, manifest, read, versions

LINEAGE = ("env", "cfg")


def rows(spark, *pairs, env="env"):
    return spark.createDataFrame([(m, x, "r", env, "cfg") for m, x in pairs], "model string, x int, run_id string, env_hash string, config_hash string")


def held(spark, path, version=None):
    return sorted((r.model, r.x) for r in read(spark, path, version).collect())


def test_parts_are_replaced_and_old_versions_stay_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read(spark, path) is None and versions(spark, path) == []
    assert commit(rows(spark, ("a", 1), ("b", 2), (None, 3)), path, LINEAGE, "model") == 1
    assert commit(rows(spark, ("b", 4), ("c/=é", 5)), path, LINEAGE, "model", emptied=["a"]) == 2
    got = [(r.model, r.x) for r in read(spark, path).collect()]
    assert sorted(got, key=str) == sorted([("b", 4), ("c/=é", 5), (None, 3)], key=str)
    assert {r.x for r in read(spark, path, 1).collect()} == {1, 2, 3}
    assert commit(rows(spark, ("b", 9)), path, LINEAGE, "model", append=True) == 3
    assert {r.x for r in read(spark, path).collect()} == {3, 4, 5, 9}
    assert commit(rows(spark), path, LINEAGE) == 4 and read(spark, path).count() == 0
    with pytest.raises(ValueError, match="no version 9"):
        read(spark, path, 9)


def test_a_writer_killed_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commit(rows(spark, ("a", 1)), path, LINEAGE, "model")
    broken = rows(spark, ("a", 2), ("b", 3)).withColumn("x", F.when(F.col("model") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        commit(broken, path, LINEAGE, "model")
    assert held(spark, path) == [("a", 1)]
    monkeypatch.setattr(versioned, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        commit(rows(spark, ("a", 7)), path, LINEAGE, "model")
    assert held(spark, path) == [("a", 1)] and versions(spark, path) == [1]
    monkeypatch.undo()
    assert commit(rows(spark, ("a", 8)), path, LINEAGE, "model") == 2
    expire(spark, path, keep=1)
    assert held(spark, path) == [("a", 8)] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    commit(rows(spark, ("a", 1)), path, LINEAGE, "model")
    late = {**manifest(spark, path), "parts": {}}
    with pytest.raises(ConflictError):
        versioned._publish(spark, path, late)
    assert held(spark, path) == [("a", 1)]
    assert not [f for f in (tmp_path / "t" / "manifests").iterdir() if f.name.endswith(".tmp")]


def test_lineage_is_part_of_the_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    commit(rows(spark, ("a", 1)), path, LINEAGE, "model")
    with pytest.raises(LineageError):
        commit(rows(spark, ("b", 2), env="other"), path, LINEAGE, "model")
    with pytest.raises(LineageError):
        commit(rows(spark, ("b", 2), env="other"), path, ("other", "cfg"), "model")
    with pytest.raises(LineageError):
        commit(rows(spark, ("b", 2)).drop("run_id"), path, LINEAGE, "model")
    assert held(spark, path) == [("a", 1)]
    assert commit(rows(spark, ("b", 2), env="other"), path, ("other", "cfg")) == 2     # a whole new table


def test_score_resumes_after_a_failure_between_its_writes(people, spark, tmp_path, monkeypatch):
    df = stages.with_cells(people, "d", {"all": None})
    run = stages.Run("r1", *LINEAGE)
    path, preds = str(tmp_path / "scores"), str(tmp_path / "preds")
    real = stages.append_rows

    def dies(rows_, where, **kw):
        if where == path:
            raise RuntimeError("lost")
        real(rows_, where, **kw)

    counts = lambda d, by, n_init: (d.groupBy(*by).count(), d.select(*by, "item", "window"))
    monkeypatch.setattr(stages.frozen, "score", counts)
    monkeypatch.setattr(stages, "append_rows", dies)
    with pytest.raises(RuntimeError, match="lost"):
        stages.score(df, path, run, preds, n_init=1)
    monkeypatch.setattr(stages, "append_rows", real)
    n = spark.read.parquet(preds).count()
    assert stages.score(df, path, run, preds, n_init=1) is not None
    assert spark.read.parquet(preds).count() == n == people.count()
    assert stages.score(df, path, run, preds, n_init=1) is None


def test_finish_refuses_a_foreign_table(spark, tmp_path):
    rows(spark, ("a", 1), env="other").write.parquet(str(tmp_path / "t"))
    with pytest.raises(LineageError):
        stages.finish(spark, {"t": str(tmp_path / "t")}, str(tmp_path / "m"), stages.Run("r", *LINEAGE))


def test_learn_publishes_versions(people, spark, tmp_path):
    df = people.withColumns({"dataset": F.lit("d"), "subset": F.lit("all")})
    run = stages.Run("r1", *LINEAGE)
    stages.learn(df, str(tmp_path), run, methods=["frozen"], with_clusters=False)
    assert read(spark, f"{tmp_path}/closed_set/frozen").count() == 1
    assert read(spark, f"{tmp_path}/repeats/frozen").count() == 12
    assert read(spark, f"{tmp_path}/leave_individuals_out/frozen").count() == 1
    with pytest.raises(LineageError):
        stages.learn(df, str(tmp_path), stages.Run("r2", "other", "cfg"), methods=["frozen"], with_clusters=False)


def test_manifest_names_bytes_and_file_digests(spark, tmp_path):
    for name in ("t", "u"):
        rows(spark, ("a", 1), ("b", 2)).repartition(2).write.parquet(str(tmp_path / name))
    run = stages.Run("r", *LINEAGE)
    found = {r.path: r for r in stages.finish(spark, {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}, str(tmp_path / "m"), run).collect()}
    files = list((tmp_path / "t").glob("*.parquet"))
    assert found["t"].bytes == sum(f.stat().st_size for f in files) and found["t"].n_files == len(files)
    assert found["t"].n_rows == 2 and found["t"].md5_content == found["u"].md5_content
    assert found["t"].md5_files == found["u"].md5_files        # equal files under other names
    empty = folder_digest(spark, str(tmp_path / "t"), "*.none").first()
    assert (empty.n_files, empty.bytes, empty.md5_files) == (0, 0, "d41d8cd98f00b204e9800998ecf8427e")     # md5 of nothing


@pytest.mark.parametrize("stage", [stages.score, stages.learn, stages.diagnose])
def test_stages_refuse_features_of_another_environment(people, spark, tmp_path, stage):
    sets = spark.createDataFrame([("a", "env", "cfg"), ("b", "env", "cfg")], "feature_set string, env_hash string, config_hash string")
    run = stages.Run("r", *LINEAGE)
    stages.gate(sets, run)
    with pytest.raises(LineageError, match="disagree"):
        stage(people, str(tmp_path), run, provenance=sets.union(spark.createDataFrame([("c", "old", "cfg")], sets.schema)))
    with pytest.raises(LineageError, match="come from"):
        stage(people, str(tmp_path), stages.Run("r", "other", "cfg"), provenance=sets)
