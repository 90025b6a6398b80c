"""Models of different vector length in one job, and readers' edge cases."""

from pyspark.sql import functions as F

from likeness.functions import text as X
from likeness.operators.classify import centroid_predictions, fold_scores
from likeness.operators.splits import group_folds, within_label_split
from likeness.sources.tables import read_master


def accuracy(df):
    folds = group_folds(df, by=["model"])
    rows = fold_scores(centroid_predictions(folds, ["model"]), ["model"]).collect()
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def test_two_lengths_score_as_alone(people):
    short = people.withColumn("model", F.lit("short")).withColumn("v", F.slice("v", 1, 4))
    both = people.unionByName(short).coalesce(1)
    got = accuracy(both)
    assert got == sorted(accuracy(people) + accuracy(short))


def test_models_draw_the_same_items(people):
    other = people.withColumn("model", F.lit("other"))
    rows = within_label_split(people.unionByName(other), ["model"]).where("is_test").select("model", "item").collect()
    sets = [{r["item"] for r in rows if r["model"] == m} for m in ("m", "other")]
    assert sets[0] and sets[0] == sets[1]


def test_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x ""q"", y",1\n"\tNA\n",2\n')
    assert [tuple(r) for r in read_master(spark, str(tmp_path / "t.csv")).collect()] == [('x "q", y', "1"), (None, "2")]


def test_sizes_round_half_to_even(spark):
    row = spark.range(1).select(X.human_size(F.lit(249.25 * 1024)).alias("s")).first()
    assert row["s"] == "249.2 KB"
