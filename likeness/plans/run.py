"""Whole stages over canonical frames: what a run of the pipeline does, as a handful of jobs.

Each stage takes DataFrames and writes tables; a stage that is run again only works on the keys
its table does not hold yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness import settings as S
from likeness.operators import diagnostics as D
from likeness.operators import lineage, quality
from likeness.operators.templates import item_means
from likeness.plans import frozen, learned
from likeness.session import bounded, durable
from likeness.sources import versioned
from likeness.sources.files import folder_digest
from likeness.sources.sinks import append_rows, replace_table
from likeness.sources.tables import path_exists
from likeness.streaming.incremental import pending

KEYS = ["dataset", "subset", "item_set", "model"]


@dataclass(frozen=True)
class Run:
    """Identity of a run; every written row carries it."""

    run_id: str
    env_hash: str
    config_hash: str

    @property
    def lineage(self) -> tuple[str, str]:
        return self.env_hash, self.config_hash

    def stamp(self, df: DataFrame) -> DataFrame:
        return lineage.stamp(df, self.run_id, self.env_hash, self.config_hash)


def gate(provenance: DataFrame | None, run: Run) -> None:
    """Stop a stage whose feature sets disagree with each other or were made in another environment than the run's."""
    if provenance is not None:
        lineage.check_features(provenance, run.env_hash)


def with_cells(df: DataFrame, dataset: str, subsets: dict[str, dict | None], item_set: str = "single") -> DataFrame:
    """The canonical frame with its cell columns; a row takes part in every subset that admits it.

    All subsets share one scan.
    """
    rows = df if item_set == "all" else df.filter(F.col("kind") == item_set)
    names = []
    for name, rule in subsets.items():
        if rule is None:
            names.append(F.lit(name))
        else:
            (column, value), = rule.items()
            names.append(F.when(F.col(column) == value, F.lit(name)))
    tags = F.array_compact(F.array(*names))
    return rows.withColumns({"dataset": F.lit(dataset), "item_set": F.lit(item_set), "subset": F.explode(tags)})


def validate(master: DataFrame, expected: DataFrame, files: DataFrame | None = None,
             checksums: DataFrame | None = None, name: str = "dataset") -> DataFrame:
    """``check, n, first`` of every problem of a metadata table; empty when it passes.

    ``expected`` holds ``check, expected`` for clips, single, individuals and recordings.
    """
    lost = quality.missing_columns(master, S.REQUIRED_COLUMNS)
    if lost:
        raise ValueError(f"missing column(s): {', '.join(lost)}")
    seen = master.agg(
        F.count("*").alias("clips"), F.count_if(F.col("kind") == "single").alias("single"),
        F.countDistinct("bird").alias("individuals"), F.countDistinct("recording_id").alias("recordings"),
    ).withColumn("scope", F.lit(name))
    wanted = expected.select(F.lit(name).alias("scope"), "check", F.col("expected").cast("double"),
                             F.lit(0.0).alias("tolerance"))
    counts = quality.expectation_report(seen, ["scope"], wanted).filter(F.col("outcome") != "pass").select(
        F.concat(F.lit("expected "), "check").alias("check"), F.col("observed").cast("long").alias("n"),
        F.col("expected").cast("string").alias("first"))
    dup = quality.duplicate_keys(master, ["original_stem"]).agg(
        F.sum(F.col("n") - 1).alias("n"), F.min("original_stem").alias("first")).filter(F.col("n") > 0)
    nul = quality.null_report(master, "recording_id", "original_stem").filter(F.col("n_missing") > 0)
    out = counts.unionByName(dup.select(F.lit("duplicate key").alias("check"), "n", "first")).unionByName(
        nul.select(F.lit("no group").alias("check"), F.col("n_missing").alias("n"), F.col("first_missing").alias("first")))
    if files is not None:
        items = master.select(F.col("rel_audio_path").alias("path"))
        status = quality.file_status(items, files, checksums)
        report = quality.problem_report(status, [])
        out = out.unionByName(report.select(F.concat(F.lit("file "), "status").alias("check"), "n", "first"))
    return out


def score(df: DataFrame, path: str, run: Run, predictions: str | None = None, n_init: int = 10,
          provenance: DataFrame | None = None) -> DataFrame | None:
    """Score the cells that ``path`` does not hold yet and append their rows.

    ``provenance`` holds the environment and configuration hashes of the feature sets behind ``df``.
    """
    gate(provenance, run)
    spark = df.sparkSession
    done = spark.read.parquet(path) if path_exists(spark, path) else None
    if done is not None:
        lineage.check_table(done, *run.lineage)
    todo = bounded(pending(df, done, KEYS))
    rows = df.join(todo, KEYS, "left_semi")
    if not rows.limit(1).count():
        return None
    result, preds = frozen.score(rows, KEYS, n_init)
    if predictions:
        # Predictions go first and are resumed by their own keys: a run that dies between the two writes leaves
        # cells without a result row, and the next run scores them without writing their predictions twice.
        old = spark.read.parquet(predictions) if path_exists(spark, predictions) else None
        fresh = preds if old is None else preds.join(bounded(pending(preds, old, KEYS)), KEYS, "left_semi")
        append_rows(run.stamp(fresh), predictions, expected=run.lineage)
    result = run.stamp(durable(result))
    append_rows(result, path, expected=run.lineage)
    return result


def learn(df: DataFrame, path: str, run: Run, methods: list[str] | None = None, provenance: DataFrame | None = None, **options) -> None:
    """Both evaluations of every method; each table publishes a version that replaces the parts of the given models.

    Read them with ``versioned.read``.
    """
    gate(provenance, run)
    by = ["dataset", "subset", "model"]
    for method in methods or [learned.FROZEN, *S.LOSSES]:
        closed = learned.closed_set(df, by, method, with_probe=method == learned.FROZEN, **options)
        versioned.commit(run.stamp(closed), f"{path}/closed_set/{method}", run.lineage, "model")
        repeats = durable(learned.leave_individuals_out(df, by, method, **options))
        versioned.commit(run.stamp(repeats), f"{path}/repeats/{method}", run.lineage, "model")
        cols = ["eer", "ari", "ami", "open_set_auroc", *[f"few_shot_{n}" for n in S.FEW_SHOT_SHOTS]]
        cols = [c for c in cols if c in repeats.columns]
        summary = learned.summarise_repeats(repeats, by, cols).drop("method")
        versioned.commit(run.stamp(summary), f"{path}/leave_individuals_out/{method}", run.lineage, "model")


def diagnose(df: DataFrame, path: str, run: Run, classifier: str = "probe", provenance: DataFrame | None = None) -> None:
    """Group shift, strata and kinship tables; split structure from metadata alone."""
    gate(provenance, run)
    by = ["dataset", "model"]
    keep = [*by, "item", "ind", "grp", "stratum", "family"]
    items = item_means(df.select(*keep, "v"), keep)
    tables = {
        "domain_shift": D.domain_shift(items, by, classifier),
        "within_stratum": D.within_stratum(items, by),
        "kinship": D.kinship(items, by),
        "split_structure": D.split_structure(df.select("dataset", "item", "ind", "grp").distinct(), ["dataset"]),
    }
    for name, t in tables.items():
        replace_table(run.stamp(t), f"{path}/{name}", expected=run.lineage)


def finish(spark: SparkSession, tables: dict[str, str], path: str, run: Run | None = None) -> DataFrame:
    """Write and return the manifest of result tables: ``path, n_rows, md5_content, n_files, bytes, md5_files``.

    With ``run``, a table of another lineage stops it.
    """
    found = {name: spark.read.parquet(p) for name, p in tables.items()}
    for df in found.values() if run else []:
        lineage.check_table(df, *run.lineage)
    stored = None
    for name, p in tables.items():
        one = folder_digest(spark, p, "*.parquet").withColumn("path", F.lit(name))
        stored = one if stored is None else stored.unionByName(one)
    result = durable(lineage.manifest(found).join(stored, "path"))
    result.write.mode("overwrite").parquet(path)
    return result
