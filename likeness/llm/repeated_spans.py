"""Repeated byte strings: Burrows-Wheeler transforms of shards, merged by interleave refinement.

A text is first cut down to where a repeat can lie. Every window of ``length`` bytes contains the
least hash among its k-grams (the rightmost of equals); that k-gram is the window's anchor and
depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. Only
anchors that occur twice can lead to a repeat. Around each, the segment of all windows that
contain it is kept, aligned at the anchor.

Segments are dealt over buckets by anchor. In a bucket, each shard sorts its own segments from the
last column to the first and keeps, per column, the symbols in the order of what follows them: the
shard's transform, column by column. Merging starts from an arbitrary interleave of the shards and
refines it once per column by the symbols drawn from the shards' transforms (a stable split by
symbol), never by comparing suffixes. Common prefixes follow along: neighbours with the same symbol
have one more than the least common prefix between them before the split. An interval of suffixes
that share ``length`` bytes is a repeat.
"""

from __future__ import annotations

from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import POWERS, mix, slices, small_batches, stored, text_key, utf8

GRAM = 40                   # bytes of an anchor
PAD = 0xFF                  # never part of UTF-8
CHUNK = 1 << 22             # a longer text is searched in parts that overlap by a window
BUCKET_BYTES = 24 << 20     # segments that meet in one merge
SHARDS = 4                  # transforms merged in a bucket
_POS = np.uint64(24)        # low bits of a key that hold a position


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of the anchors of all windows of some rows."""
    n, span = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    low = ((grams >> _POS) << _POS) | (np.uint64((1 << 24) - 1) - at)       # equal hashes: the rightmost is least
    step = 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    inside = np.arange(len(low)) + length <= ends[:len(low)]
    found = np.unique(np.uint64((1 << 24) - 1) - (low[inside] & np.uint64((1 << 24) - 1))).astype(np.int64)
    row = np.searchsorted(bounds, found, side="right") - 1
    return row, found - bounds[row], grams[found]


def _parts(offsets: np.ndarray, length: int):
    """(first row, bounds in the data, start inside the row) of pieces that together hold every window once."""
    for lo, hi in slices(offsets):
        size = int(offsets[hi] - offsets[lo])
        if size <= CHUNK:
            yield lo, offsets[lo:hi + 1], 0
        else:
            for start in range(0, size, CHUNK):
                stop = min(size, start + CHUNK + length - 1)
                yield lo, np.array([offsets[lo] + start, offsets[lo] + stop]), start


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, h, pos) of every text of (h, text)."""
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, bounds, start in _parts(offsets, length):
                row, pos, grams = anchors_of(data[bounds[0]:bounds[-1]], bounds - bounds[0], length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(grams.view(np.int64)), batch.column(0).take(pa.array(row + lo)),
                    pa.array(pos + start)], names=["anchor", "h", "pos"])

    return docs.select("h", "text").mapInArrow(run, "anchor long, h binary, pos long")


def segments(texts: DataFrame, length: int) -> DataFrame:
    """(h, pos, anchor, d, seg) around every listed anchor of (h, text, found); d is the segment's digest."""
    left = length - GRAM

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keys, found = batch.column(0), batch.column(2).to_pylist()
            for i, places in enumerate(found):
                text = data[offsets[i]:offsets[i + 1]]
                padded = np.full(len(text) + left + length, PAD, np.uint8)
                padded[left:left + len(text)] = text
                pos = np.array([p["pos"] for p in places], np.int64)
                for at in range(0, len(pos), 4096):
                    some = pos[at:at + 4096]
                    rows = padded[some[:, None] + np.arange(left + length)]
                    segs = [r.tobytes() for r in rows]
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(np.full(len(some), i))), pa.array(some),
                        pa.array([p["anchor"] for p in places[at:at + 4096]], pa.int64()),
                        pa.array([md5(s).digest() for s in segs], pa.binary()), pa.array(segs, pa.binary())],
                        names=["h", "pos", "anchor", "d", "seg"])

    return texts.select("h", "text", "found").mapInArrow(run, "h binary, pos long, anchor long, d binary, seg binary")


# Transforms -----------------------------------------------------------------------------------
def transform(rows: np.ndarray) -> np.ndarray:
    """Column c holds the symbols of column c in the order of the suffixes that start at column c + 1."""
    count, width = rows.shape
    order, out = np.arange(count), np.empty((width, count), np.uint8)
    for c in range(width - 1, -1, -1):
        symbols = rows[order, c]
        out[c] = symbols
        order = order[np.argsort(symbols, kind="stable")]
    return out


def _least(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of ranges (first, last] from a table of minima over powers of two."""
    size = last - first
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(size), table[0].dtype)
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(table[k][first[here] + 1], table[k][last[here] + 1 - (1 << int(k))])
    return out


def merge(shards: list[np.ndarray], length: int) -> np.ndarray:
    """repeated[i, c]: does the window of segment i (shards in turn) that starts at column c occur again?"""
    width = shards[0].shape[0]
    counts = [s.shape[1] for s in shards]
    total = sum(counts)
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), counts)      # the interleave
    segment, common = np.arange(total), np.zeros(total, np.int16)
    repeated = np.zeros((total, width - length + 1), bool)
    symbols = np.empty(total, np.uint8)
    for c in range(width - 1, -1, -1):
        symbols[np.argsort(source, kind="stable")] = np.concatenate([s[c] for s in shards])
        split = np.argsort(symbols, kind="stable")
        drawn = symbols[split]
        grown = np.zeros(total, np.int16)
        first, last = split[:-1], split[1:]
        same = drawn[1:] == drawn[:-1]
        beside = same & (last == first + 1)
        grown[1:][beside] = common[last[beside]] + 1
        apart = np.flatnonzero(same & ~beside)
        if len(apart):
            table = [common]
            while 2 << (len(table) - 1) <= total:
                half = 1 << (len(table) - 1)
                table.append(np.minimum(table[-1][:-half], table[-1][half:]))
            grown[1:][apart] = _least(table, first[apart], last[apart]) + 1
        common, source, segment = grown, source[split], segment[split]
        if c <= width - length:
            long = common >= length
            long[:-1] |= common[1:] >= length
            repeated[segment, c] = long
    return repeated


def _shard(table: pa.Table) -> pa.Table:
    width = len(table.column("seg")[0].as_py())
    segs = b"".join(table.column("seg").to_pylist())
    columns = transform(np.frombuffer(segs, np.uint8).reshape(-1, width))
    return pa.table({
        "bucket": table.column("bucket")[:1], "d": pa.array([b"".join(table.column("d").to_pylist())], pa.binary()),
        "twice": pa.array([np.array([n > 1 for n in table.column("n").to_pylist()], bool).tobytes()], pa.binary()),
        "columns": pa.array([columns.tobytes()], pa.binary())})


def _merged(length: int):
    width, left = 2 * length - GRAM, length - GRAM

    def run(table: pa.Table) -> pa.Table:
        digests = b"".join(table.column("d").to_pylist())
        twice = np.frombuffer(b"".join(table.column("twice").to_pylist()), bool)
        shards = [np.frombuffer(x, np.uint8).reshape(width, -1) for x in table.column("columns").to_pylist()]
        starts = merge(shards, length)
        starts[twice] = True
        edge = np.zeros((len(starts), 1), np.int8)
        change = np.diff(np.concatenate([edge, starts.view(np.int8), edge], axis=1), axis=1)
        row, at = np.nonzero(change == 1)
        stop = np.nonzero(change == -1)[1]
        return pa.table({"d": pa.array([digests[16 * i:16 * i + 16] for i in row], pa.binary()),
                         "first": pa.array(at - left, pa.int64()), "last": pa.array(stop - 1 - left, pa.int64())})

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Remove every byte that lies in a string of ``length`` bytes which starts anywhere else too.

    One row per input row: the id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining
    bytes). Strings never cross texts and are judged on the input. A null text is empty; texts
    shorter than ``length`` have no strings; copies of a text, also in rows with equal ids, repeat
    each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       text_key(F.col(text_col)).alias("h"))
    all_anchors = anchors(rows, length)
    live = all_anchors.groupBy("anchor").count().where("count > 1").select("anchor")
    found = stored(all_anchors.join(live, "anchor").groupBy("h")
                   .agg(F.collect_set(F.struct("pos", "anchor")).alias("found")))
    texts = rows.select("h", "text").join(found, "h").dropDuplicates(["h"])
    cut = stored(segments(texts, length))
    copies = rows.groupBy("h").count().where("count > 1").select("h", F.lit(2).alias("copies"))
    size = cut.count() * (2 * length - GRAM)
    buckets = max(1, -(-size // BUCKET_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    distinct = (cut.select("d", "anchor", "seg").groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.first("anchor").alias("anchor"),
                                                                  F.first("seg").alias("seg")))
    dealt = distinct.select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"),
                            F.pmod(F.hash("d"), F.lit(SHARDS)).alias("shard"), "d", "n", "seg")
    shards = dealt.groupBy("bucket", "shard").applyInArrow(_shard, "bucket long, d binary, twice binary, columns binary")
    runs = stored(shards.groupBy("bucket").applyInArrow(_merged(length), "d binary, first long, last long"))
    spans = (cut.select("h", "pos", "d").join(runs, "d")
             .select("h", (F.col("pos") + F.col("first")).alias("first"), (F.col("pos") + F.col("last")).alias("last"))
             .groupBy("h").agg(F.collect_set(F.struct("first", "last")).alias("starts")))
    marked = spans.join(copies, "h", "full").select("h", "starts", "copies")
    out = rows.join(stored(marked), "h", "left")

    def remove(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            starts, copied = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            removed, spans_, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                if copied[i] and len(text) >= length:
                    gone[0], gone[-1] = 1, -1
                elif starts[i]:
                    at = np.array([(s["first"], s["last"]) for s in starts[i]], np.int64)
                    ok = (at[:, 1] >= 0) & (at[:, 0] + length <= len(text))
                    at = at[ok]
                    np.add.at(gone, np.maximum(at[:, 0], 0), 1)
                    np.add.at(gone, np.minimum(at[:, 1], len(text) - length) + length, -1)
                mask = np.cumsum(gone[:-1]) > 0
                rest = text[~mask].tobytes() if mask.any() else text.tobytes()
                removed.append(int(mask.sum()))
                spans_.append(int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(mask) else 0)
                digests.append(sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()),
                pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return out.select("id", "text", "starts", "copies").mapInArrow(
        remove, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
