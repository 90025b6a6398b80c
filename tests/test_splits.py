import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from likeness.operators import splits
from likeness.operators.ranking import hash_rank
from likeness.functions.text import draw_key

BY = ["model"]


def brute_deal(sizes, k):
    """One group after the other, largest first, to the lightest fold."""
    k = min(k, len(sizes))
    loads, out = [0] * k, []
    for s in sorted(sizes, reverse=True):
        j = int(np.argmin(loads))
        loads[j] += s
        out.append((s, j))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80), st.integers(1, 7))
def test_segments_equal_one_by_one_dealing(sizes, k):
    hist = pd.Series(sizes).value_counts().rename_axis("n").reset_index(name="c")
    dealt = []
    for s, start, end, folds in splits._deal_segments(hist, k):
        dealt += [(s, folds[(r - start) % len(folds)]) for r in range(start, end)]
    assert dealt == brute_deal(sizes, k)


def test_one_huge_group_is_dealt_without_stepping():
    hist = pd.DataFrame({"n": [10**12, 1], "c": [1, 10**12]})
    segs = splits._deal_segments(hist, 5)
    assert len(segs) < 12
    loads = [0] * 5
    for s, start, end, folds in segs:
        for i, j in enumerate(folds):
            loads[j] += s * ((end - start) // len(folds) + (i < (end - start) % len(folds)))
    assert sum(loads) == 2 * 10**12 and max(loads) == 10**12


def test_known_sizes_balance(spark):
    sizes = {"a": 5, "b": 4, "c": 3, "d": 3, "e": 2, "f": 1}
    df = spark.createDataFrame([("m", g) for g, n in sizes.items() for _ in range(n)], "model string, grp string")
    loads = splits.group_fold_table(df, BY, k=3).groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert sorted(r.n for r in loads) == [6, 6, 6]


@pytest.mark.parametrize("strategy", ["greedy", "rank_mod", "hash"])
def test_no_group_on_both_sides(people, strategy):
    f = splits.group_folds(people, BY, strategy=strategy)
    r = splits.leak_check(f, BY).first()
    assert r.leaking_groups == 0 and f.count() == people.count()


def test_every_group_fold_is_scored(people):
    r = splits.leak_check(splits.group_folds(people, BY), BY).first()
    assert r.n_folds == 5 and r.enrolled_folds == 5


def test_stratified_folds_are_balanced_per_class(people):
    f = splits.stratified_folds(people, BY)
    counts = f.groupBy("ind", "fold").count().groupBy("ind").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in counts)
    same = splits.stratified_folds(people, BY, unique=True)
    assert {(r.item, r.fold) for r in f.collect()} == {(r.item, r.fold) for r in same.collect()}


def test_folds_do_not_depend_on_partitioning(spark, people):
    def assign():
        return {(r.item, r.fold) for r in splits.group_folds(people, BY).collect()} | {
            (r.item, -1 - r.fold) for r in splits.stratified_folds(people, BY).collect()}

    first = assign()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert assign() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_hash_rank_is_the_plain_rank(spark, people):
    key = draw_key("t", "item")
    got = {r.item: r["rank"] for r in hash_rank(people, ["ind"], key, tie=["item"]).collect()}
    rows = sorted((r.ind, r.k, r.item) for r in people.withColumn("k", key).collect())
    want, seen = {}, {}
    for ind, _, item in rows:
        seen[ind] = seen.get(ind, 0) + 1
        want[item] = seen[ind]
    assert got == want


def test_validation_slice_sizes(spark):
    sizes = {"a": 1, "b": 2, "c": 10, "d": 20}
    rows = [("m", f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "model string, item string, ind string")
    got = {r.ind: r.n for r in splits.validation_split(df, BY).groupBy("ind").agg(
        F.count_if("is_validation").alias("n")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_within_label_split_keeps_a_training_item(spark):
    rows = [("m", i, "x") for i in range(10)] + [("m", 99, "y")]
    df = spark.createDataFrame(rows, "model string, item long, ind string")
    got = {r.ind: (r.tr, r.te) for r in splits.within_label_split(df, BY).groupBy("ind").agg(
        F.count_if(~F.col("is_test")).alias("tr"), F.count_if("is_test").alias("te")).collect()}
    assert got == {"x": (8, 2), "y": (1, 0)}


def test_held_out_sets_have_the_right_size(people):
    held = splits.held_out_individuals(people, BY, repeats=6, n=2)
    assert all(r["count"] == 2 for r in held.groupBy("repeat").count().collect())
    assert held.select("repeat").distinct().count() == 6


def test_thinned_samples_meet_their_condition(people):
    cond = [(3, 2), (2, 3)]
    s = splits.thinned_samples(people, BY, cond, draws=3).persist()
    per = s.groupBy("groups", "items", "draw", "ind", "grp").count()
    assert all(r["count"] == r["items"] for r in per.collect())
    groups = per.groupBy("groups", "items", "draw", "ind").agg(F.count("*").alias("g")).collect()
    assert all(r.g == r.groups for r in groups) and len(groups) == 2 * 3 * 4


def test_eligible_needs_every_condition(spark):
    rows = [("m", "a", g) for g in ("1", "2") for _ in range(4)] + [("m", "b", "3")] * 8
    df = spark.createDataFrame(rows, "model string, ind string, grp string")
    assert [r.ind for r in splits.eligible_individuals(df, BY, [(2, 2), (1, 4)]).collect()] == ["a"]
