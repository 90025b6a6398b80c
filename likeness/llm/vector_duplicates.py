"""Near-duplicate vectors by collision counting over many one-dimensional projections."""

from __future__ import annotations

from hashlib import blake2b
from math import ceil, comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import components, small_batches, stored
from likeness.session import spread

PROJECTIONS = 40
STEPS = 10                  # half width of a query's window, in quantised cells
REACH = 63                  # cells on either side of zero; differences then fit a signed byte
BLOCK = 4096                # vectors whose windows are laid out at a time
STRIP_BYTES = 64 << 20      # of vectors in a strip
PAIRS = 1 << 16             # pairs joined at a time
TILE = 256                  # queries counted at a time
MISS = 1e-4                 # share of pairs at the limit that the count may lose


def window_width(cosine: float) -> float:
    """Half width of the window: one deviation of the projected difference of a pair at the limit."""
    return sqrt(2 - 2 * cosine)


def least_count(projections: int = PROJECTIONS, miss: float = MISS) -> int:
    """The largest count that a pair at the limit reaches with probability 1 - ``miss`` at least.

    A pair at the limit meets in one window with probability ``erf(1 / sqrt(2))``, nearer pairs more
    often; counts over independent projections are binomial.
    """
    hit = erf(1 / sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if below > miss:
            return count
    return projections


def projected(units: np.ndarray, cosine: float) -> np.ndarray:
    """Quantised projections (rows x PROJECTIONS, signed bytes) of unit vectors."""
    lines = np.random.default_rng(7919 + units.shape[1]).normal(size=(units.shape[1], PROJECTIONS))
    cells = np.rint(units @ lines * (STEPS / window_width(cosine)))
    return np.clip(cells, -REACH, REACH).astype(np.int8)


class Windows:
    """For each projection, the vectors sorted along it and, per cell, those in the window around it."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        self.inside = np.zeros((PROJECTIONS, 2 * REACH + 1, len(codes)), np.uint8)
        cells = np.arange(-REACH, REACH + 1)
        for j in range(PROJECTIONS):
            order = np.argsort(codes[:, j], kind="stable")
            along = codes[order, j].astype(np.int16)
            first = np.searchsorted(along, cells - STEPS, side="left")
            last = np.searchsorted(along, cells + STEPS, side="right")
            for cell in range(len(cells)):
                self.inside[j, cell, order[first[cell]:last[cell]]] = 1

    def counts(self, queries: np.ndarray) -> np.ndarray:
        """How many windows of each query every vector lies in."""
        out = np.zeros((len(queries), self.size), np.uint8)
        met = np.empty_like(out)
        for j in range(PROJECTIONS):
            np.take(self.inside[j], queries[:, j].astype(np.int16) + REACH, axis=0, out=met, mode="clip")
            out += met
        return out


def strip_count(nodes: int, nbytes: int, tasks: int) -> int:
    """Strips whose pairs make about ``tasks`` units of work: every vector is copied once per strip, so there are no more
    than that unless a strip would outgrow a task."""
    return max(1, min(ceil(nodes / BLOCK), max(ceil(sqrt(2 * tasks)), ceil(nbytes / STRIP_BYTES))))


def candidate_pairs(left: np.ndarray, right: np.ndarray, need: int, same: bool):
    """Index pairs whose collision count passes, a tile of queries against a block of vectors at a time."""
    for j in range(0, len(right), BLOCK):
        windows = Windows(right[j:j + BLOCK])
        end = min(j + BLOCK, len(left)) if same else len(left)
        for i in range(0, end, TILE):
            a, b = np.nonzero(windows.counts(left[i:min(i + TILE, end)]) >= need)
            a, b = a + i, b + j
            if same:
                a, b = a[a < b], b[a < b]
            yield a, b


def _prepared(rows: DataFrame, cosine: float) -> DataFrame:
    """(id, node, dim, codes, unit) of each row; node is null for vectors that link with nothing."""
    def run(batches):
        for batch in batches:
            nodes, dims, codes, units = [], [], [], []
            for row in batch.column(1).to_pylist():
                v = None if row is None or any(x is None for x in row) else np.array(row, np.float64)
                norm = 0.0 if v is None or not len(v) or not np.isfinite(v).all() else np.linalg.norm(v / np.abs(v).max()) if v.any() else 0.0
                if not norm:
                    nodes.append(None), dims.append(None), codes.append(None), units.append(None)
                    continue
                v = v + 0.0
                unit = v / np.abs(v).max() / norm
                nodes.append(blake2b(v.tobytes(), digest_size=16).digest())
                dims.append(len(v))
                codes.append(projected(unit[None], cosine).tobytes())
                units.append(unit.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(codes, pa.binary()),
                 pa.array(units, pa.binary())], names=["id", "node", "dim", "codes", "unit"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node binary, dim int, codes binary, unit binary")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           cosine: float = 0.95) -> DataFrame:
    """Link rows whose vectors have a cosine of ``cosine`` or more, in double precision.

    One row per input row: the id, n_links (other rows linked directly), component_id (least id
    reachable, itself included) and kept. Equal vectors are one node with a multiplicity. Nodes are
    dealt over strips; every pair of strips is one unit of work, which counts window collisions block
    by block, verifies the pairs that pass and returns a sum of links per node and a spanning forest,
    not the pairs. Strips follow the cores, so the copies of a vector do not grow with the rows.
    Counting over single projections has no cheaper exact form, so work grows with the square of the
    distinct vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
    vectors of other lengths and rows without an id. Equal ids of different vectors stay apart.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(_prepared(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), cosine))
    nodes = stored(rows.where("node is not null and id is not null").groupBy("node", "dim").agg(
        F.count(F.lit(1)).alias("m"), F.min("id").alias("id"), F.first("codes").alias("codes"), F.first("unit").alias("unit")))
    distinct, nbytes = nodes.agg(F.count(F.lit(1)), F.sum(F.octet_length("unit"))).first()     # two numbers; they only set the strips
    blocks = strip_count(distinct, nbytes or 0, 4 * spark.sparkContext.defaultParallelism)
    need, limit = least_count(), cosine
    dealt = nodes.select("*", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    partners = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(
        F.least(j, "block").alias("lo"), F.greatest(j, "block").alias("hi")))
    units = dealt.select("*", F.explode(partners).alias("pair")).select("dim", "pair.lo", "pair.hi", "block", "node", "m", "codes", "unit")

    def work(table: pa.Table) -> pa.Table:
        lo, hi, dim = (table.column(c)[0].as_py() for c in ("lo", "hi", "dim"))
        block = np.array(table.column("block").to_pylist())
        sides = []
        for b in (lo, hi):
            part = table.filter(pa.array(block == b))
            sides.append((part.column("node").to_pylist(), np.array(part.column("m").to_pylist(), np.int64),
                          np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int8).reshape(-1, PROJECTIONS),
                          np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, dim)))
        (names, m, codes, unit), (names2, m2, codes2, unit2) = sides
        same = lo == hi
        links, links2 = np.zeros(len(names), np.int64), np.zeros(len(names2), np.int64)
        forest = Forest(len(names) + (0 if same else len(names2)))
        shift = 0 if same else len(names)
        near, waiting = [], 0
        for a, b in candidate_pairs(codes, codes2, need, same):
            for at in range(0, len(a), PAIRS):
                x, y = a[at:at + PAIRS], b[at:at + PAIRS]
                ok = np.einsum("ij,ij->i", unit[x], unit2[y]) >= limit
                x, y = x[ok], y[ok]
                np.add.at(links, x, m2[y])
                np.add.at(links2, y, m[x])
                near.append((x, y + shift))
                waiting += len(x)
                if waiting >= PAIRS:
                    forest.join(*map(np.concatenate, zip(*near)))
                    near, waiting = [], 0
        if near:
            forest.join(*map(np.concatenate, zip(*near)))
        both = names if same else names + names2
        total = links + links2 if same else np.concatenate([links, links2])
        root = forest.roots()
        some = np.flatnonzero((total > 0) | (root != np.arange(len(root))))
        return pa.table({"node": pa.array([both[i] for i in some], pa.binary()), "links": pa.array(total[some]),
                         "root": pa.array([both[i] for i in root[some]], pa.binary())})

    spread_units = spread(units, ["dim", "lo", "hi"], 2 * blocks * (blocks + 1))      # so that few tasks get two units
    found = stored(spread_units.groupBy("dim", "lo", "hi").applyInArrow(work, "node binary, links long, root binary"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (grouped.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("component_id"))
             .join(grouped, "root").select("node", "component_id"))
    per_node = (nodes.select("node", "m", F.col("id").alias("own")).join(sums, "node", "left").join(named, "node", "left")
                .select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                        F.coalesce("component_id", "own").alias("component_id")))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(per_node, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


class Forest:
    """Components of growing sets of index pairs; every index knows the least index it reaches."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while True:
            x, y = up[a], up[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            self._flatten()

    def _flatten(self) -> None:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return
            self.up[:] = above

    def roots(self) -> np.ndarray:
        self._flatten()
        return self.up
