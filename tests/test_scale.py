"""What the queries' costs at size hang on: work done once, strips by cells, rows that stay where they are."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from likeness import settings as S
from likeness.functions.text import draw_key
from likeness.operators import cluster, head, models, ranking, similarity
from likeness.operators import metrics as M
from likeness.plans import frozen, oracle

BY = ["model"]


@pytest.mark.parametrize("dim", [3, 30])
def test_supcon_in_few_dimensions_is_the_loss_over_all_pairs(dim):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(23, dim)), rng.integers(0, 4, 23), rng.normal(size=(dim + 1, 9))
    z = head._forward(x, w)[0]
    s = (z @ z.T - 1) / S.TEMPERATURE
    other = ~np.eye(23, dtype=bool)
    pos = (y[:, None] == y) & other
    row = [np.log(np.exp(s[i][other[i]]).sum()) - s[i][pos[i]].mean() for i in range(23) if pos[i].any()]
    value, g = head._supcon_loss(x, y, w, True, chunk=5)
    assert value == pytest.approx(np.mean(row), rel=1e-8)
    for i, j in [(0, 0), (dim, 4), (1, 8)]:
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        diff = (head._supcon_loss(x, y, w + d, False)[0] - head._supcon_loss(x, y, w - d, False)[0]) / 2e-6
        assert diff == pytest.approx(g[i, j], rel=1e-4, abs=1e-7)


def test_a_head_is_trained_once_however_often_its_vectors_are_read(people):
    rows = people.withColumn("is_train", F.col("item") % 5 != 0).withColumn("x", F.col("v"))
    plan = head.head_vectors(rows, BY, "proto", max_epochs=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" not in plan


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    rows = [("m", i, f"p{i % 7}", f"g{i % 25}", rng.normal(size=8).tolist()) for i in range(6000)]
    return spark.createDataFrame(rows, "model string, item long, ind string, grp string, v array<double>").persist()


def test_tiles_of_a_pair_histogram_do_not_shrink_with_the_strips(cloud):
    def seconds(block_rows):
        start = time.time()
        r = M.auc_eer(similarity.pair_histogram(cloud, BY, item=["item"], block_rows=block_rows), BY).first()
        return time.time() - start, (r.n_pos, r.n_neg, round(r.auc, 9))

    seconds(4096)
    wide, narrow = seconds(4096), seconds(8)
    assert wide[1] == narrow[1]
    assert narrow[0] < 2 * wide[0] + 2


def test_cells_share_the_strip_pairs(spark, cloud):
    cells = cloud.withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(20))))
    q, r = cells.withColumnRenamed("v", "_q"), cells.withColumnRenamed("v", "_v")
    tasks = 4 * spark.sparkContext.defaultParallelism
    for on, sides in ((["cell"], (q, r)), ([], (q.where("cell = 1"), r))):
        t = similarity._strip_table(*sides, on, 5, 64, similarity.STRIP_BYTES).toPandas()
        assert tasks / 2 <= (t._q_strips * t._r_strips).sum() <= 3 * tasks
        assert (t._q_strips <= t._r_strips).all() or on      # 5 candidates of each strip, 20 references a query
    got = similarity.nearest(cells.where("item < 40"), cells.withColumnRenamed("item", "ref").withColumnRenamed("v", "t"), ["cell"], ["item"],
                             ["ref"], k=2, q_vec="v", broadcast_rows=0, block_rows=64)
    assert got.groupBy("item", "rank", "ref").count().where("count <> 20").isEmpty() and got.count() == 40 * 2 * 20


def test_passes_of_kmeans_leave_the_rows_where_they_are(spark, cloud):
    small = cloud.where("item < 700").withColumn("window", F.lit(0)).persist()
    by_table = cluster.kmeans_assign(small, BY, n_init=2)
    by_blocks = cluster.kmeans_assign(small, BY, n_init=2, max_iter=300, block_rows=200, small_bytes=0)
    pair = by_table.select("item", F.col("cluster").alias("a")).join(by_blocks.select("item", "cluster"), "item")
    assert pair.where("a = cluster").count() == 700
    dealt = cluster._Blocks(small.select(*BY, "item", F.col("v").alias("_x")), BY, ["item"], 200)
    centroids = small.where("item < 7").select(*BY, F.lit(0).alias("run"), F.col("item").cast("int").alias("cluster"), F.col("v").alias("c"))
    plan = cluster._sums(dealt, centroids.toArrow(), BY)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan          # rows are neither shuffled nor sorted in a pass


def test_tasks_of_a_pass_of_kmeans_follow_cores_not_rows(spark, cloud):
    """Every task sends its own sums in a pass, so what a pass shuffles must not grow with the rows."""
    rows = cloud.where("item < 700").select(*BY, "item", F.col("v").alias("_x"))
    dealt = cluster._Blocks(rows, BY, ["item"], 10)
    assert dealt.tasks <= spark.sparkContext.defaultParallelism and dealt.rows.count() == 700
    centroids = cloud.where("item < 7").select(*BY, F.lit(0).alias("run"), F.col("item").cast("int").alias("cluster"), F.col("v").alias("c"))
    by_table, by_blocks = (cluster._sums(dealt, c, BY).select("cluster", "n").orderBy("cluster").collect() for c in (centroids.toArrow(), centroids))
    assert by_table == by_blocks and sum(r.n for r in by_table) == 700


def test_sql_of_the_model_tables_draws_the_rows_that_the_fits_draw(cloud):
    rows = cloud.withColumn("window", F.lit(0)).withColumn("ind", F.when(F.col("item") < 90, "rare").otherwise(F.col("ind")))
    con = duckdb.connect()
    con.register("rows", rows.select(F.col("model").alias("cell"), "item", F.col("window").alias("win"), "ind").toPandas())
    for bound in (700, 6000):
        want = con.execute(f"WITH {oracle.fit_sample('rows', 's', 'probe_fit', bound)} SELECT item FROM s ORDER BY item").fetchall()
        got = models.fit_sample(rows, BY, "ind", ["item", "window"], "probe_fit", bound).select("item").orderBy("item").collect()
        assert [r.item for r in got] == [r[0] for r in want] and (len(got) == 6000) == (bound == 6000)


def test_a_centroid_without_rows_stays():
    table = pa.table({"model": ["m"] * 3, "run": [0] * 3, "cluster": [0, 1, 2], "c": [[0.0, 0.0], [1.0, 1.0], [5.0, 5.0]], "_open": [True] * 3})
    sums = pa.table({"model": ["m"] * 2, "run": [0] * 2, "cluster": [0, 1], "s": [[0.0, 0.0], [4.0, 2.0]], "n": [3, 2]})
    got = cluster._moved(table, sums, BY, 1e-4).to_pydict()
    assert got["c"] == [[0, 0], [2, 1], [5, 5]] and got["_open"] == [True] * 3
    assert not any(cluster._moved(table, sums, BY, 2.0)["_open"].to_pylist())


def _shuffled_rows(df):
    """Rows that the shuffles of an executed plan wrote."""
    def walk(node):
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_many_first_rows_of_a_key_are_found_without_sorting_all_of_it(spark, cloud):
    """Spark prunes rankings of up to 1,000 rows only: the first 4,096 rows of a cell, on which KMeans starts, took all its vectors to one task."""
    key, was = draw_key("kmeans", "item"), spark.conf.get("spark.sql.adaptive.enabled")
    want = [r.item for r in cloud.orderBy(key, "item").limit(1500).collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # one plan, whose metrics can be read
    try:
        got = ranking.first_by_key(cloud, BY, key, 1500, ["item"])
        assert sorted(r.item for r in got.collect()) == sorted(want) and got.columns == cloud.columns
        assert 1500 <= _shuffled_rows(got) < 1600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    keyless = cloud.withColumn("model", F.when(F.col("item") % 2 == 0, "m"))
    assert ranking.first_by_key(keyless, BY, key, 1200, ["item"]).groupBy("model").count().select("count").collect() == [(1200,), (1200,)]
    assert ranking.first_by_key(cloud, BY, key, 7000, ["item"]).count() == ranking.first_by_key(cloud, [], key, 7000, ["item"]).count() == 6000


def test_tables_per_class_and_block_travel_to_the_vectors(spark, cloud):
    """Joins by label or cell shuffled every vector before a fit drew its sample and before a model met its rows."""
    rows, was = cloud.withColumn("window", F.lit(0)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sample = models.fit_sample(rows, BY, "ind", ["item", "window"], "probe_fit", 700)
        weights = spark.createDataFrame([("m", [0.0])], "model string, w array<double>")
        applied = models.apply_models(rows, weights, BY, ["item"], [], lambda block, model: {})
        for df in (sample, applied):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert applied.count() == 6000


def test_vectors_meet_their_folds_once_in_a_score(people, monkeypatch):
    seen = []

    def probe(splits, cell):
        seen.append(splits.storageLevel.useMemory)
        splits.unpersist()
        raise InterruptedError

    monkeypatch.setattr(frozen, "probe_predictions", probe)
    with pytest.raises(InterruptedError):
        frozen.score(people, BY)
    assert seen == [True]


def test_sql_of_the_probe_counts_all_train_rows():
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT i AS vec_id, CAST(i % 3 AS INTEGER) AS label, [CAST(i AS FLOAT), 1.0] AS embedding FROM range(21000) t(i)")
    got = con.execute(oracle.ORACLE["probe_models"]).fetchall()
    assert len(got) == 5 and sum(r[3] for r in got) == 4 * 21000


def test_first_centroids_are_drawn_among_all_rows(cloud):
    rows = cloud.withColumn("_x", F.col("v")).withColumn("_kinds", F.lit(5)).select("model", "item", "_x", "_kinds").persist()
    want = cluster.first_centroids(rows, BY, ["item"], 2, 7, seed_rows=6000).orderBy("run", "cluster").collect()     # in one task
    got = cluster.first_centroids(rows, BY, ["item"], 2, 7).orderBy("run", "cluster").collect()
    assert got == want and len(got) == 10
    x = np.array([r._x for r in rows.orderBy("item").collect()])
    at = int(cluster._uniform("7|0|0") * 6000)          # by hand: the first draw, and the second by squared distances to it
    near = np.cumsum(((x - x[at]) ** 2).sum(axis=1))
    assert got[0].c == x[at].tolist() and got[1].c == x[np.searchsorted(near, cluster._uniform("7|0|1") * near[-1])].tolist()


def test_a_screen_in_single_precision_finds_the_same_nearest_reference(monkeypatch):
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, r = unit(rng.normal(size=(700, 16))), unit(rng.normal(size=(6000, 16)))
    near = unit(q[:200] + 1e-9 * rng.normal(size=(200, 16)))       # differ less than single precision sees
    cases = [(q, r), (q, np.vstack([r, near, q[:200], q[:200], near])), (q, np.repeat(q[:3], 2000, axis=0)), (1e3 * q, -1e-3 * r), (0 * q, r)]
    found = [similarity._top_positions(a, b, 1, 9) for a, b in cases]
    assert all(similarity._best_positions(a, b, 9) is not None for a, b in cases)
    assert similarity._best_positions(q, np.vstack([r, np.full((1, 16), np.nan)]), 9) is None
    monkeypatch.setattr(similarity, "SCREEN_ROWS", 10**9)
    for (a, b), (positions, scores) in zip(cases, found):
        want = similarity._top_positions(a, b, 1, 9)
        assert (positions == want[0]).all() and (scores == want[1]).all()
