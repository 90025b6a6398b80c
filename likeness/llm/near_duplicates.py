"""Near-duplicate documents by b-bit MinHash: packed signatures, bands, bit counts, full-set check."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import (
    components, mix, slices, small_batches, stored, text_key, translation, utf8, word_hashes,
)

HASHES = 576            # minima of a signature
BITS = 2                # low bits kept of each
MISS = 1e-4             # a pair at the limit shares no band with at most this probability
DEVIATIONS = 4          # of the estimated similarity at the limit; what lies further below is left out
TILE = 1024             # members of a bucket that a comparison in a task takes from each side, about
TILE_BYTES = 16 << 20   # bytes of their texts, about
PAIRS = 1 << 17         # pairs that are compared at once
ROUNDS = 2              # rounds in which a bucket's members meet a few of them, before those left meet all
STARS = 3               # members of a bucket that the others meet in a round
BLANKS = translation(lambda c: c == 32 or 9 <= c <= 13)
_SEEDS = np.random.default_rng(20240229)
MULTIPLY = (_SEEDS.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _SEEDS.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row, in row order; fewer words make one shingle."""
    data, offsets = utf8(texts)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 2**64)) for i in range(width)]
    for lo, hi in slices(offsets):
        part = BLANKS[data[offsets[lo]:offsets[hi]]]
        words, at = word_hashes(part, offsets[lo:hi + 1] - offsets[lo])
        for i in range(hi - lo):
            w = words[at[i]:at[i + 1]]
            m = len(w)
            if m == 0:
                yield w
            elif m < width:
                total = np.uint64(m)
                for j in range(m):
                    total = total + w[j:j + 1] * factors[j]
                yield mix(total)
            else:
                total = w[:m - width + 1] * factors[0]
                for j in range(1, width):
                    total = total + w[j:m - width + 1 + j] * factors[j]
                yield np.unique(mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 64):
        values = short[i:i + 64, None] * MULTIPLY
        values += ADD
        np.minimum(low, values.min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> list[int]:
    """``BITS`` low bits of every minimum, mixed so that unequal minima differ by chance, in 64-bit words."""
    kept = mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shift = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return (kept.reshape(-1, per) << shift).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def band_rows(percent: int) -> int:
    """The most minima a band can have so that pairs at the limit miss all bands with probability ``MISS`` at most."""
    limit = min(percent, 100) / 100
    return max((r for r in range(1, 33) if (1 - limit**r) ** (HASHES // r) <= MISS), default=1)


def margin(percent: int) -> float:
    """How far below the limit an estimate may lie."""
    chance = 1 / (1 << BITS)
    equal = chance + (1 - chance) * min(percent, 100) / 100
    return DEVIATIONS * float(np.sqrt(equal * (1 - equal) / HASHES)) / (1 - chance)


def bands(low: np.ndarray, rows: int) -> list[int]:
    n = HASHES // rows
    parts = mix(low[:n * rows].astype(np.uint64).reshape(n, rows) + (np.arange(n, dtype=np.uint64)[:, None] << np.uint64(33)))
    total = np.arange(n, dtype=np.uint64)
    for j in range(rows):
        total = mix(total * np.uint64(31) + parts[:, j])
    return total.view(np.int64).tolist()


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """Per row: id, text key, set size, node (the set's digest), bands and packed signature."""
    def run(batches):
        for batch in batches:
            sizes, nodes, all_bands, all_bits = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), all_bands.append(None), all_bits.append(None)
                    continue
                low = minima(s)
                nodes.append(blake2b(s.tobytes(), digest_size=16).digest())
                all_bands.append(bands(low, rows))
                all_bits.append(packed(low))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                pa.array(all_bands, pa.list_(pa.int64())), pa.array(all_bits, pa.list_(pa.int64()))],
                names=["id", "h", "n", "node", "bands", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", text_key("text").alias("h")).mapInArrow(
        run, f"id {kind}, h binary, n long, node binary, bands array<long>, bits array<long>")


def estimate(a: str, b: str):
    """Similarity from the bit counts of two packed signatures, corrected for chance agreement."""
    odd = F.lit(sum(1 << i for i in range(0, 64, BITS)))
    unequal = None
    for i in range(HASHES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        count = F.bit_count(folded.bitwiseAND(odd))
        unequal = count if unequal is None else unequal + count
    chance = 1 / (1 << BITS)
    return ((HASHES - unequal) / F.lit(HASHES) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have ``100 * |A and B| >= percent * |A or B|``.

    One row per input row: id, h (text key), n_shingles, node (digest of the set), root (node that
    names the component; null for rows that take no part), component_id
    (least id reachable over links, itself included) and kept. Documents with equal sets are one
    node, so copies make no pairs. Bands propose pairs. For a few rounds every member of a bucket that
    holds several components meets ``STARS`` members, others each time, so that groups of alike
    documents become one component in linear work. Then, in buckets that still hold several, every
    member outside the largest component meets the members of other components: no candidate is
    left out, but pairs inside a component are not made. Large buckets are dealt in tiles. A task compares
    the packed signatures of a tile and confirms pairs whose estimated similarity is at most ``margin`` below
    the limit on the full sets of the texts that came along; it returns links only, and none between
    components that its earlier links join already. So a task returns fewer rows than it has read.

    Empty and null texts have no shingles and are linked with nothing; a row without an id takes
    no part and is kept; equal ids of different texts are separate nodes. Ties need no rule.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(rows, width, band_rows(percent)))
    used = signed.where("node is not null and id is not null")
    nodes = used.groupBy("node").agg(F.min("id").alias("id"), F.min("h").alias("h"), F.first("bands").alias("bands"),
                                     F.first("bits").alias("bits"))
    nodes = stored(nodes)
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = stored(banded.join(shared, "bucket"))
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "h", "bands", "bits")
    # one text per node; copies of a text are equal, so any of them serves
    texts = stored(rows.select("text", text_key("text").alias("h")).join(wanted, "h")
                   .groupBy("node").agg(F.first("text").alias("text"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    found, bits = texts.select("node", F.col("node").alias("root")), texts.select("node", "bits")
    for turn in range(ROUNDS):
        placed = members.join(found, "node")
        least = [F.min(F.struct(F.xxhash64(F.lit(turn * STARS + i), "node").alias("order"), "node", "root")) for i in range(STARS)]
        stars = placed.groupBy("bucket").agg(F.array(*least).alias("s"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        stars = stars.select("bucket", F.explode(F.array_distinct(F.transform("s", lambda s: F.struct(
            s["node"].alias("star"), s["root"].alias("other"))))).alias("s")).select("bucket", "s.star", "s.other")
        # signatures come along, so only pairs that look similar enough leave the bucket
        stars = stars.join(bits.select(F.col("node").alias("star"), F.col("bits").alias("y")), "star")
        pairs = placed.join(bits.withColumnRenamed("bits", "x"), "node").join(stars, "bucket").where("root <> other").where(
            estimate("x", "y") >= percent / 100 - margin(percent)).select(
            F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()
        links = stored(_confirmed(pairs, texts, width, percent))
        if links.isEmpty():
            break
        found = _joined(found, links)
    placed = members.join(found, "node")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    open_ = stored(placed.join(mixed.select("bucket"), "bucket"))
    links = found.limit(0) if open_.isEmpty() else stored(_tiled_links(open_, texts, width, percent))
    final = found if links.isEmpty() else _joined(found, links)
    named = final.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("component_id"))
    grouped = final.join(named, "root").select("node", "root", "component_id")
    lone = nodes.select("node", F.col("id").alias("own"))
    by_node = lone.join(grouped, "node", "left").select("node", F.coalesce("root", "node").alias("root"),
                                                        F.coalesce("component_id", "own").alias("component_id"))
    out = signed.join(by_node, "node", "left")
    alone = F.col("node").isNull() | F.col("id").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "h", F.col("n").alias("n_shingles"), "node", F.when(~alone, F.col("root")).alias("root"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, root) after the links between nodes are added: roots of linked nodes are one."""
    edges = (links.join(found.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
             .join(found.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y"))
    merged = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return stored(found.join(merged.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left")
                  .select("node", F.coalesce("least", "root").alias("root")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the least id, then the least text key.

    Texts without words and rows without an id are groups of their own; of rows that repeat an id and
    its text one stays. Columns named _id and _h are left out.
    """
    docs = docs.drop("_id", "_h")
    found = near_duplicates(docs, id_col, text_col, **limits)
    keep = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("id"), "h")).alias("k"))
    keep = keep.select(F.col("k.id").alias("_id"), F.col("k.h").alias("_h"))
    text = F.col(text_col)
    apart = F.col(id_col).isNull() | text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
    names = docs.columns
    keyed = docs.where(~apart).select("*", F.col(id_col).alias("_id"), text_key(text).alias("_h"))
    grouped = keyed.join(keep, ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select(*names)
    return grouped.unionByName(docs.where(apart))


def _tiled_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, as many as it takes to join the components.

    A bucket's members are dealt to strips of about ``TILE`` members and ``TILE_BYTES``; two strips are compared in one task.
    """
    sized = members.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    largest = (sized.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes")).groupBy("bucket").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"),
        F.ceil(F.greatest(F.sum("count") / TILE, F.sum("bytes") / TILE_BYTES)).cast("int").alias("strips")))
    dealt = members.join(largest, "bucket").select(
        "bucket", "node", "root", (F.col("root") != F.col("main")).alias("outside"), "strips",
        F.pmod(F.xxhash64("node"), "strips").cast("int").alias("strip"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).select(
        "bucket", F.least("strip", "other").alias("i"), F.greatest("strip", "other").alias("j"), "strip", "node", "root", "outside")
    tiles = tiles.join(texts.select("node", "bands", "bits", "text"), "node").select(
        "bucket", "i", "j", "strip", "node", "root", "outside", "bands", "bits", "text")
    least = percent / 100 - margin(percent)

    def run(batches):
        held, joined = None, {}
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = (part if held is None else pa.concat_tables([held, part])).combine_chunks()
            starts = _run_starts(part)
            yield from _links(part.slice(0, starts[-1]), starts[:-1], least, width, percent, joined)
            held = part.slice(starts[-1])
        if held is not None:
            yield from _links(held, np.zeros(1, np.int64), least, width, percent, joined)

    found = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "x binary, y binary")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _links(part: pa.Table, starts: np.ndarray, least: float, width: int, percent: int, joined: dict[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    """Links of each tile between components that those found before do not join.

    ``joined`` holds the components that a task's links have joined, each with one that stands for it. A pair is
    confirmed in the first bucket that its nodes share; that bucket holds two components and so has a tile for it.
    """
    if not part.num_rows:
        return
    part = part.combine_chunks()
    texts, roots = part["text"].combine_chunks(), part["root"].combine_chunks()
    bands_of = part["bands"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
    own = (bands_of == part["bucket"].to_numpy()[:, None]).argmax(axis=1)
    ends = np.append(starts[1:], part.num_rows)
    tile, sets = -1, {}

    def top(root):
        passed = []
        while root in joined:
            passed.append(root)
            root = joined[root]
        joined.update(dict.fromkeys(passed, root))
        return root

    def full(k):
        if k not in sets:
            sets[k] = next(shingle_sets(texts.slice(k, 1), width))
        return sets[k]

    def holds(left, right):
        nonlocal tile
        keep = np.ones(len(left), bool)
        for i in range(bands_of.shape[1]):
            keep &= (own[left] <= i) | (bands_of[left, i] != bands_of[right, i])
        for p in np.flatnonzero(keep):
            k, m = int(left[p]), int(right[p])
            if k >= tile:           # the sets of earlier tiles are not needed again
                tile = int(ends[np.searchsorted(ends, k, side="right")])
                sets.clear()
            x, y = top(roots[k].as_py()), top(roots[m].as_py())
            keep[p] = x != y and _alike(full(k), full(m), percent)
            if keep[p]:
                joined[max(x, y)] = min(x, y)
        return keep

    yield from _similar(part, starts, least, holds)


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _run_starts(part: pa.Table) -> np.ndarray:
    """Where the tiles of a sorted table begin; it has a row at least."""
    keys = [part[c].to_numpy() for c in ("bucket", "i", "j")]
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _similar(part: pa.Table, starts: np.ndarray, least: float, holds=None) -> Iterator[pa.RecordBatch]:
    """Node pairs of each tile whose packed signatures agree often enough, compared by bit counts.

    ``holds`` (rows left, rows right, in row order) says which of these remain.
    """
    n = part.num_rows
    if not n:
        return
    part = part.combine_chunks()
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    partners = end - np.arange(n) - 1            # every later row of the tile
    roots = part["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    outside = part["outside"].to_numpy()
    strip, across = part["strip"].to_numpy(), part["i"].to_numpy() != part["j"].to_numpy()
    bits = part["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)
    nodes = part["node"].combine_chunks()
    chance = 1 / (1 << BITS)
    most = int(HASHES * (1 - chance) * (1 - least))     # unequal values that an estimate of ``least`` allows
    odd = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    total = np.concatenate([[0], np.cumsum(partners)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(lo, hi), partners[lo:hi])
        right = left + 1 + np.arange(len(left)) - (total[left] - total[lo])
        take = (roots[left] != roots[right]) & (outside[left] | outside[right]) & (~across[left] | (strip[left] != strip[right]))
        left, right = left[take], right[take]
        unequal = np.zeros(len(left), np.int64)
        for w in range(bits.shape[1]):
            x = bits[left, w] ^ bits[right, w]
            folded = x
            for s in range(1, BITS):
                folded = folded | (x >> np.uint64(s))
            unequal += np.bitwise_count(folded & odd)
        good = unequal <= most
        left, right = left[good], right[good]
        if holds is not None and len(left):
            good = holds(left, right)
            left, right = left[good], right[good]
        if len(left):
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(left)), nodes.take(pa.array(right))], names=["x", "y"])
        lo = hi


def _confirmed(near: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    full = (near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b"))

    def confirm(batches):
        for batch in batches:
            sets = zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True)
            mask = pa.array([_alike(s, t, percent) for s, t in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return full.select("a", "b", "left", "right").mapInArrow(confirm, "a binary, b binary")
