"""Nearest references and pair-score histograms as blocked matrix products.

Spark owns the partitioning: vectors are hashed into strips (a hot label or group is spread evenly),
pairs of strips are the shuffle key, and NumPy multiplies two strips per task, tile by tile. All cells
together make about P tasks; a cell with P' of them needs about sqrt(2 P') strips, so each of its vectors is
copied that often; only strips too large for a task add copies. Tasks return top-k candidates or one histogram of scores, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions.vectors import l2, vector_sum
from likeness.session import bounded, is_small, one_thread_per_task, spread

BLOCK_ROWS = 4096
CHUNK_ROWS = 512
PAIR_CHUNK_ROWS = 1024
STRIP_BYTES = 64 << 20
SLICE_BINS = 4096
CANDIDATE_BYTES = 100       # a candidate and a vector on their way, about
VECTOR_BYTES = 550
SCORE_DECIMALS = 9
PAIR_DECIMALS = 6
SCREEN_ROWS = 1024          # references from which on a screen in single precision pays
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20


def matrix(column) -> np.ndarray:
    """An Arrow list column as a dense (rows, dim) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.unique(np.asarray(column.value_lengths()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of one evaluation differ in length: {sizes.tolist()[:5]}")
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def picked(column, index: np.ndarray) -> np.ndarray:
    """Some rows of an Arrow list column as a dense array; other rows may have another length."""
    return matrix(column.take(pa.array(index, pa.int64())))


def _top_positions(q: np.ndarray, r: np.ndarray, k: int, decimals: int):
    """Positions and scores of the k best references per query; ties go to the earlier row.

    Scores are rounded first: matrix products differ in the last bits with the block shape, and
    a tie must not depend on how rows were partitioned. References are taken tile by tile; the
    best so far stand before a tile's own, so the earlier row still wins.
    """
    k = min(k, len(r))
    if k == 1 and len(r) >= SCREEN_ROWS:
        found = _best_positions(q, r, decimals)
        if found is not None:
            return found
    positions, scores = [], []
    for start in range(0, len(q), CHUNK_ROWS):
        part = q[start:start + CHUNK_ROWS]
        rows, p, c = np.arange(len(part)), None, None
        for tile in range(0, len(r), BLOCK_ROWS):
            s = np.round(part @ r[tile:tile + BLOCK_ROWS].T, decimals) + 0.0
            at = np.broadcast_to(np.arange(tile, tile + s.shape[1]), s.shape)
            if p is not None:
                s, at = np.hstack([c, s]), np.hstack([p, at])
            p, c = [], []
            for _ in range(min(k, s.shape[1])):
                best = s.argmax(axis=1)
                p.append(at[rows, best])
                c.append(s[rows, best].copy())
                s[rows, best] = -np.inf
            p, c = np.stack(p, axis=1), np.stack(c, axis=1)
        positions.append(p)
        scores.append(c)
    return np.concatenate(positions), np.concatenate(scores)


def _best_positions(q: np.ndarray, r: np.ndarray, decimals: int):
    """``_top_positions`` for one reference per query: products in single precision tell which references may be the best
    within their rounding error, and only those are scored in double precision. None for vectors that do not fit it."""
    size = np.sqrt((q * q).sum(axis=1)), np.sqrt((r * r).sum(axis=1)).max()
    if not len(q) or not np.isfinite(size[0]).all() or not size[1] < 1e15 or size[0].max() > 1e15:
        return None
    # Rounding both sides, multiplying and adding up in single precision; then the rounding of scores.
    error = 1.1 * (q.shape[1] + 8) * 2.0 ** -24 * size[0] * size[1] + 10.0 ** -decimals
    single = r.astype(np.float32)
    at, best = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
    for start in range(0, len(q), CHUNK_ROWS):
        mine = slice(start, start + CHUNK_ROWS)
        part, part32 = q[mine], q[mine].astype(np.float32)
        for tile in range(0, len(r), BLOCK_ROWS):
            rough = part32 @ single[tile:tile + BLOCK_ROWS].T
            least = np.maximum(rough.max(axis=1) - 2 * error[mine], best[mine] - error[mine])
            i, j = np.nonzero(rough >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            if len(i) > rough.size // 64:       # many equal references
                s = np.round(part @ r[tile:tile + BLOCK_ROWS].T, decimals) + 0.0
                i, j = np.arange(len(part)), s.argmax(axis=1)
                s = s[i, j]
            else:
                s = np.round(np.einsum("ij,ij->i", part[i], r[tile + j]), decimals) + 0.0
                order = np.lexsort((j, -s, i))
                order = order[np.unique(i[order], return_index=True)[1]]
                i, j, s = i[order], j[order], s[order]
            better = s > best[start + i]
            at[start + i[better]], best[start + i[better]] = tile + j[better], s[better]
    return at[:, None], best[:, None]


def _strips(df: DataFrame, v: str, block_rows: int, strip_bytes: int):
    """Aggregates: the least number of strips that fit a task, and the most that are still worth a tile."""
    n, width = F.count("*"), F.max(F.size(v)) * 8
    return F.ceil(n * width / strip_bytes).alias("_least"), F.ceil(n / block_rows).alias("_most")


def _side(wanted):
    """``wanted`` strips, unless fewer would do or more are needed to fit a task."""
    return F.greatest(F.col("_least"), F.least(F.col("_most"), F.ceil(wanted)), F.lit(1)).cast("int")


def _tasks(df: DataFrame) -> int:
    """Units of work that keep the session's cores busy to the end, over all cells."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _share(cells: DataFrame, tasks: int):
    """A cell's part of ``tasks`` by its ``_work``; one number tells the work of all cells."""
    return F.col("_work") * (tasks / (cells.agg(F.sum("_work")).first()[0] or 1.0))


def _strip_table(queries: DataFrame, refs: DataFrame, on: list[str], k: int, block_rows: int, strip_bytes: int) -> DataFrame:
    """``on, _q_strips, _r_strips``: the cells share about ``_tasks`` pairs of strips by their numbers of products.

    A query is copied once per reference strip and brings ``k`` candidates back from each, a reference is copied
    once per query strip: the side with more bytes to copy gets fewer copies.
    """
    sizes = [df.groupBy(*on).agg(F.count("*").alias(f"_n{s}"), F.struct(*_strips(df, v, block_rows, strip_bytes)).alias(f"_s{s}"))
             for s, df, v in (("q", queries, "_q"), ("r", refs, "_v"))]
    cells = sizes[0].join(sizes[1], on) if on else sizes[0].crossJoin(sizes[1])        # one row each without keys
    cells = bounded(cells.withColumn("_work", F.col("_nq").cast("double") * F.col("_nr")))
    share = F.greatest(F.lit(1.0), _share(cells, _tasks(queries)))
    ratio = F.col("_nr") / (F.col("_nq") * F.lit(1.0 + k * CANDIDATE_BYTES / VECTOR_BYTES))
    sides = cells.withColumn("_share", share).withColumn("_wr", F.least(F.col("_share"), F.greatest(F.lit(1.0), F.sqrt(F.col("_share") * ratio))))
    sides = sides.withColumns({"_least": F.col("_sr._least"), "_most": F.col("_sr._most")}).withColumn("_r_strips", _side(F.round("_wr")))
    sides = sides.withColumns({"_least": F.col("_sq._least"), "_most": F.col("_sq._most")}).withColumn(
        "_q_strips", _side(F.col("_share") / F.col("_r_strips")))
    return bounded(sides.select(*on, "_q_strips", "_r_strips"))


def nearest(queries: DataFrame, refs: DataFrame, on: list[str], q_cols: list[str], r_cols: list[str],
            k: int = 1, q_vec: str = "v", r_vec: str = "t", decimals: int = SCORE_DECIMALS,
            broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
            block_rows: int = BLOCK_ROWS, strip_bytes: int = STRIP_BYTES, proven_small: bool = False) -> DataFrame:
    """The ``k`` best references per query by dot product, within equal ``on`` keys.

    Output: ``on, q_cols, r_cols, score, rank``. ``r_cols`` orders ties (ascending) and must
    identify a reference. References whose count and bytes were found small are shipped to the tasks and
    queries are not shuffled at all; otherwise both sides are shuffled as pairs of strips. ``proven_small`` tells
    that they derive from a table that passed such a check, and saves another one.
    """
    one_thread_per_task(queries)
    queries = queries.select(*on, *q_cols, F.col(q_vec).alias("_q"))
    refs = refs.select(*on, *r_cols, F.col(r_vec).alias("_v"))
    schema = T.StructType(
        [queries.schema[c] for c in on] + [queries.schema[c] for c in q_cols]
        + [refs.schema[c] for c in r_cols]
        + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    )
    names = schema.fieldNames()

    def emit(keys: pd.DataFrame, q: np.ndarray, labels: pd.DataFrame, r: np.ndarray) -> pd.DataFrame:
        positions, scores = _top_positions(q, r, k, decimals)
        width = positions.shape[1]
        out = keys.loc[keys.index.repeat(width)].reset_index(drop=True)
        picked = labels.iloc[positions.ravel()].reset_index(drop=True)
        out = pd.concat([out, picked], axis=1)
        out["score"] = scores.ravel()
        out["rank"] = np.tile(np.arange(1, width + 1, dtype="int32"), len(positions))
        return out[names]

    if broadcast_rows and (proven_small or _fits(refs, broadcast_rows, broadcast_bytes)):
        table = refs.toArrow()
        ref_keys = table.select(on + r_cols).to_pandas()
        order = ref_keys.sort_values(r_cols, kind="stable").index
        cells: dict[tuple, tuple] = {}
        grouped = ref_keys.loc[order].groupby(on, sort=False).groups if on else {(): order}
        for cell, index in grouped.items():
            cell = cell if isinstance(cell, tuple) else (cell,)
            index = np.asarray(index)
            cells[cell] = (ref_keys.loc[index, r_cols].reset_index(drop=True), picked(table["_v"], index))

        def scan(batches):
            for batch in batches:
                keys = batch.select(on + q_cols).to_pandas()
                if keys.empty:
                    continue
                groups = keys.groupby(on, sort=False).indices if on else {(): np.arange(len(keys))}
                for cell, index in groups.items():
                    cell = cell if isinstance(cell, tuple) else (cell,)
                    if cell in cells:
                        labels, r = cells[cell]
                        out = emit(keys.iloc[index].reset_index(drop=True), picked(batch.column("_q"), index), labels, r)
                        yield from pa.Table.from_pandas(
                            out, schema=arrow_schema, preserve_index=False).to_batches()

        arrow_schema = _arrow(schema)
        return queries.mapInArrow(scan, schema)

    strips = _strip_table(queries, refs, on, k, block_rows, strip_bytes)
    q = (
        (queries.join(strips, on) if on else queries.crossJoin(strips))
        .withColumn("_qb", F.pmod(F.xxhash64(*q_cols), F.col("_q_strips")).cast("int"))
        .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_r_strips") - 1))).drop("_q_strips", "_r_strips")
    )
    r = (
        (refs.join(strips, on) if on else refs.crossJoin(strips))
        .withColumn("_rb", F.pmod(F.xxhash64(*r_cols), F.col("_r_strips")).cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_q_strips") - 1))).drop("_q_strips", "_r_strips")
    )
    arrow_schema = _arrow(schema)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow_schema.empty_table()
        labels = right.select(r_cols).to_pandas()
        order = labels.sort_values(r_cols, kind="stable").index.to_numpy()
        out = emit(left.select(on + q_cols).to_pandas(), matrix(left["_q"]),
                   labels.iloc[order].reset_index(drop=True), matrix(right["_v"])[order])
        return pa.Table.from_pandas(out, schema=arrow_schema, preserve_index=False)

    q, r = q.toDF(*q.columns), r.toDF(*r.columns)   # queries and references may be one frame
    key = [*on, "_qb", "_rb"]
    units = _units(strips, F.col("_q_strips") * F.col("_r_strips"))
    found = spread(q, key, units).groupBy(*key).cogroup(spread(r, key, units).groupBy(*key)).applyInArrow(block, schema)
    w = Window.partitionBy(*on, *q_cols).orderBy(F.desc("score"), *r_cols)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _fits(refs: DataFrame, rows: int, nbytes: int) -> bool:
    """Count and bytes are added up before a single vector leaves its task."""
    n, width = refs.agg(F.count("*"), F.max(F.size("_v"))).first()
    return n <= rows and n * 8 * (width or 0) <= nbytes


def _units(strips: DataFrame, per_cell) -> int:
    """Number of strip pairs, if the strip table is at hand; it only sets the number of tasks."""
    if not is_small(strips):
        return 0
    return int(strips.agg(F.sum(per_cell.cast("double"))).first()[0] or 0)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pair_histogram(df: DataFrame, by: list[str], item: list[str] | None = None, label: str = "ind",
                   grp: str = "grp", v: str = "v", decimals: int = PAIR_DECIMALS,
                   block_rows: int = BLOCK_ROWS, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Cosine scores of all item pairs, counted: ``by, bin, pos, neg`` with score = bin / 10**decimals.

    pos: same individual, different group. neg: different individuals. Pairs inside one group of
    one individual are left out. A cell yields at most ``2 * 10**decimals + 1`` rows whatever the
    number of pairs.
    """
    if not 1 <= decimals <= 6:
        raise ValueError("decimals must lie in 1..6: it bounds the size of the histogram")
    one_thread_per_task(df)
    item = item or ["item", "window"]
    rows = df.select(*by, *item, F.col(label).alias("_l"), F.col(grp).alias("_g"), l2(v).alias("_v"))
    cells = bounded(df.groupBy(*by).agg(*_strips(df, v, block_rows, strip_bytes), F.pow(F.count("*").cast("double"), 2).alias("_work")))
    strips = bounded(cells.select(*by, _side(F.sqrt(2 * _share(cells, _tasks(df)))).alias("_strips")))
    rows = (
        rows.join(strips, by)
        .withColumn("_b", F.pmod(F.xxhash64(*item), F.col("_strips")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_strips") - 1)))
        .withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o"))
        .select(*by, "_lo", "_hi", "_b", "_l", "_g", "_v")
    )
    counts = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [df.schema[c] for c in by]
        + [T.StructField("_slice", T.LongType()), T.StructField("pos", counts), T.StructField("neg", counts)])
    arrow_schema = _arrow(schema)
    scale = 10 ** decimals

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[-2].as_py(), key[-1].as_py()
        vectors = matrix(table["_v"])
        who = _codes(table["_l"])
        src = _codes(table["_g"])
        side = np.asarray(table["_b"])
        size = 2 * scale + 1
        pos, neg = np.zeros(size, "int64"), np.zeros(size, "int64")

        def tally(rows_, cols, used=None):
            if not len(rows_) or not len(cols):
                return
            s = vectors[rows_] @ vectors[cols].T
            s *= scale
            bins = np.rint(s, out=s).astype("int64")
            bins += scale
            same = who[rows_][:, None] == who[cols][None, :]
            if used is not None:
                same &= used
            everything = np.bincount(bins.ravel() if used is None else bins[used], minlength=size)
            neg[:] += everything - np.bincount(bins[same], minlength=size)
            same &= src[rows_][:, None] != src[cols][None, :]
            pos[:] += np.bincount(bins[same], minlength=size)

        a = np.flatnonzero(side == lo)
        b = a if lo == hi else np.flatnonzero(side == hi)
        for start in range(0, len(a), PAIR_CHUNK_ROWS):
            part = a[start:start + PAIR_CHUNK_ROWS]
            first = 0
            if lo == hi:
                tally(part, part, np.triu(np.ones((len(part), len(part)), bool), 1))
                first = start + PAIR_CHUNK_ROWS
            for tile in range(first, len(b), BLOCK_ROWS):
                tally(part, b[tile:tile + BLOCK_ROWS])
        # One row per slice of bins: far fewer rows to add up than one per bin.
        pos, neg = [np.pad(c, (0, -size % SLICE_BINS)).reshape(-1, SLICE_BINS) for c in (pos, neg)]
        keep = np.flatnonzero((pos + neg).any(axis=1))
        cells = {c: [key[i].as_py()] * len(keep) for i, c in enumerate(by)}
        return pa.table({**cells, "_slice": keep, "pos": list(pos[keep].astype(float)), "neg": list(neg[keep].astype(float))},
                        schema=arrow_schema)

    rows = spread(rows, [*by, "_lo", "_hi"], _units(strips, F.col("_strips") * (F.col("_strips") + 1) / 2))
    counted = rows.groupBy(*by, "_lo", "_hi").applyInArrow(count, schema)
    total = counted.groupBy(*by, "_slice").agg(vector_sum("pos").alias("pos"), vector_sum("neg").alias("neg"))
    bins = total.select(*by, "_slice", F.posexplode(F.arrays_zip("pos", "neg")).alias("_i", "_c"))
    whole = lambda c: F.rint(c).cast("long")
    return bins.select(
        *by, (F.col("_slice") * SLICE_BINS + F.col("_i") - scale).alias("bin"),
        whole(F.col("_c.pos")).alias("pos"), whole(F.col("_c.neg")).alias("neg"),
    ).filter((F.col("pos") > 0) | (F.col("neg") > 0))


def score_histogram(df: DataFrame, by: list[str], score: str, is_positive, decimals: int = PAIR_DECIMALS) -> DataFrame:
    """The same histogram for one score per row."""
    return df.groupBy(*by, F.rint(F.col(score) * 10 ** decimals).cast("long").alias("bin")).agg(
        F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg"))


def _codes(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.dictionary_encode().indices)
