"""Phrases of words that stand together, mined from a weighted de Bruijn graph.

Every word of a piece opens one record: the longest gram that starts there, cut short where the piece
ends. Whole grams are edges from their first to their last ``longest - 1`` words; the cut ones are the
corrections at piece ends. Records are added up by their first two words in one sorted stream, in which
a shorter gram is a run of records with the same beginning: its count is the flow out of its node
plus the records that end there.

Edges below ``least`` can hold no candidate and only enter flows. In what remains, nodes with one way
in and one way out and nothing lost are interior to a path; paths are compacted by pointer doubling and
kept as one word list with one weight. A phrase inside such a path has the path's weight and lies in
a longer phrase that is as frequent, so it is no candidate and is never scored. Longest candidates
are read from the paths, shorter ones from the nodes that remain.

Words travel as 64-bit hashes of language and word. A dictionary of all words runs along in the same
stream and a collision between two of them stops the job, so counts are exact.

A null text is empty, a null language is ``und``, repeated rows count again, an empty table gives an
empty result, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.llm.common import POWERS, mix, small_batches, stored, utf8
from likeness.llm.common import slices as row_slices

PIECE_END, WORD_END = 1, 2
FLUSH_WORDS = 1 << 20
KNOWN_WORDS = 1 << 21
KINDS = np.zeros(256, np.uint8)
KINDS[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = PIECE_END
KINDS[[ord(c) for c in " \t"]] = WORD_END
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _h(k: int) -> list[str]:
    return [f"h{i}" for i in range(1, k + 1)]


def cut_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some rows: where they start and end, their piece's number, their row."""
    kinds = KINDS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = kinds == 0
    first, last = word & edge[:-1], word & edge[1:]
    first[1:] |= word[1:] & ~word[:-1]
    last[:-1] |= word[:-1] & ~word[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, np.cumsum(kinds == PIECE_END)[starts] + row, row


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of language and word; 0 is kept for the end of a piece."""
    up, down = POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return np.maximum(mix(mix((total[ends] - total[starts]) * down[starts]) ^ lang), np.uint64(1))


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


def _records(longest: int):
    """Arrow batches of (lang, text) -> records, words and sums, each added up per flush."""

    def add_up(grams: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        # Equal rows meet by one mixed key; two rows that share a key merely stay apart.
        key = grams[:, 0].copy()
        for c in range(1, grams.shape[1]):
            key = mix(key + grams[:, c])
        grams = grams[np.argsort(key, kind="stable")]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        return grams[at], np.diff(np.append(at, len(grams)))

    def batch(grams, n, lang, word):
        columns = [pa.array(grams[:, c].view(np.int64)) for c in range(longest)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), lang, word], names=[*_h(longest), "n", "lang", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        held, size, sums = [], 0, {}

        def flush():
            grams, n = add_up(np.concatenate(held))
            none = pa.nulls(len(n), pa.string())
            yield batch(grams, n, none, none)

        for b in batches:
            data, offsets = utf8(b.column(1))
            langs = b.column(0).fill_null("und").to_pylist()
            keys = {x: _lang_key(x) for x in set(langs)}
            lang_of = np.array([keys[x] for x in langs], np.uint64)
            for lo, hi in row_slices(offsets):
                part = LOWER[data[offsets[lo]:offsets[hi]]]
                starts, ends, piece, row = cut_words(part, offsets[lo:hi + 1] - offsets[lo])
                if not len(starts):
                    continue
                h = word_keys(part, starts, ends, lang_of[lo:hi][row])
                grams = np.zeros((len(h), longest), np.uint64)
                grams[:, 0] = h
                for k in range(1, longest):
                    same = piece[k:] == piece[:-k]
                    grams[:-k, k][same] = h[k:][same]
                for r, c in zip(*np.unique(row, return_counts=True)):
                    sums[langs[lo + r]] = sums.get(langs[lo + r], 0) + int(c)
                # words this task has not yet named
                seen, where = np.unique(h, return_index=True)
                fresh = ~np.isin(seen, known, assume_unique=True) if len(known) else np.ones(len(seen), bool)
                if fresh.any():
                    at = where[fresh]
                    raw = part.tobytes()
                    words = pa.array([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], pa.binary()).cast(pa.string())
                    named = np.zeros((len(at), longest), np.uint64)
                    named[:, 0] = seen[fresh]
                    yield batch(named, np.zeros(len(at), np.int64), pa.array([langs[lo + r] for r in row[at].tolist()], pa.string()), words)
                    known = np.concatenate([known, seen[fresh]]) if len(known) < KNOWN_WORDS else seen[fresh]
                held.append(grams)
                size += len(grams)
                if size >= FLUSH_WORDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        if sums:
            zero = np.zeros((len(sums), longest), np.uint64)
            yield batch(zero, np.array(list(sums.values())), pa.array(list(sums), pa.string()), pa.nulls(len(sums), pa.string()))

    return run


def _flows(longest: int, least: int):
    """Records sorted by their words -> counts of every beginning; one open run per length is carried on."""

    def out(level, grams, n, lang=None, word=None):
        columns = [pa.array(grams[:, c].view(np.int64) if grams.dtype == np.uint64 else grams[:, c]) for c in range(longest)]
        none = pa.nulls(len(n), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), level, np.int32)), *columns, pa.array(n, pa.int64()),
             none if lang is None else lang, none if word is None else word],
            names=["level", *_h(longest), "n", "lang", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_runs = {k: None for k in range(1, longest + 1)}
        last_word = None

        def done(k, grams, n):
            keep = n >= (1 if k == 1 else least)
            keep &= (grams[:, :k] != 0).all(axis=1)
            if keep.any():
                found = grams[keep]
                found[:, k:] = 0
                yield out(k, found, n[keep])

        for b in batches:
            grams = np.stack([np.asarray(b.column(c)) for c in range(longest)], axis=1)
            n, word = np.asarray(b.column(longest)), b.column(longest + 2)
            named = ~np.asarray(word.is_null())
            if named.any():
                mine = b.filter(pa.array(named))
                at, fresh = mine.column(0).to_pylist(), []
                for i, this in enumerate(zip(at, mine.column(longest + 1).to_pylist(), mine.column(longest + 2).to_pylist())):
                    if last_word is not None and this[0] == last_word[0]:
                        if this != last_word:
                            raise ValueError(f"two words share a hash: {this} {last_word}")
                        continue
                    last_word = this
                    fresh.append(i)
                if fresh:
                    mine = mine.take(pa.array(fresh))
                    yield out(0, grams[named][fresh], np.zeros(len(fresh), np.int64), mine.column(longest + 1), mine.column(longest + 2))
            total = (grams[:, 0] == 0) & ~named
            if total.any():
                mine = b.filter(pa.array(total))
                yield out(-1, grams[total], n[total], mine.column(longest + 1))
            rest = ~named & ~total
            grams, n = grams[rest], n[rest]
            if not len(n):
                continue
            new = np.zeros(len(n), bool)
            for k in range(1, longest + 1):
                new[1:] |= grams[1:, k - 1] != grams[:-1, k - 1]
                new[0] = True
                at = np.flatnonzero(new)
                heads, sums = grams[at], np.add.reduceat(n, at)
                before = open_runs[k]
                if before is not None:
                    if (before[0][0, :k] == heads[0, :k]).all():
                        sums[0] += before[1][0]
                    else:
                        yield from done(k, *before)
                open_runs[k] = heads[-1:].copy(), sums[-1:].copy()
                if len(sums) > 1:
                    yield from done(k, heads[:-1], sums[:-1])
        for k, run_ in open_runs.items():
            if run_ is not None:
                yield from done(k, *run_)

    return run


def flows(docs: DataFrame, longest: int, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``level, h1.., n, lang, word``: level -1 sums per language, 0 the dictionary, 1 parts of word counts,
    2 and more the counts of phrases that are at least ``least``."""
    small_batches(docs.sparkSession)
    columns = ", ".join(f"{c} long" for c in [*_h(longest), "n"])
    records = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(
        _records(longest), f"{columns}, lang string, word string")
    dealt = records.repartition("h1", "h2").sortWithinPartitions(*_h(longest), "lang", "word")
    return dealt.mapInArrow(_flows(longest, least), f"level int, {columns}, lang string, word string")


# Graph ----------------------------------------------------------------------------------------
def compacted(edges: DataFrame, nodes: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Paths ``(words, n)`` that hold every edge once, and the nodes between them.

    ``edges`` are grams of ``longest`` words, ``nodes`` those of one word less, both with count n. A node is
    interior if one edge enters, one leaves, and both have its own count: no other edge and no piece
    begins or ends there. A closed ring of interior nodes cannot be, for every piece begins somewhere.
    """
    k = longest - 1
    side = lambda names: [F.col(c).alias(h) for c, h in zip(names, _h(k))]
    leave = edges.groupBy(*side(_h(k))).agg(F.count("*").alias("_o"), F.max("n").alias("_on"))
    enter = edges.groupBy(*side(_h(longest)[1:])).agg(
        F.count("*").alias("_i"), F.max("n").alias("_in"), F.max("h1").alias("_before"))
    joined = nodes.join(leave, _h(k), "left").join(enter, _h(k), "left")
    inner = (F.col("_o") == 1) & (F.col("_i") == 1) & (F.col("_on") == F.col("n")) & (F.col("_in") == F.col("n"))
    joined = stored(joined.select(*_h(k), "n", F.coalesce(inner, F.lit(False)).alias("_inner"), "_before"))
    edge = F.struct(*_h(longest))
    before = F.struct(F.col("_before").alias("h1"), *[F.col(a).alias(b) for a, b in zip(_h(k), _h(longest)[1:])])
    links = edges.join(joined.where("_inner").drop("n"), _h(k), "left").select(
        edge.alias("e"), F.when(F.col("_inner"), before).otherwise(edge).alias("p"),
        F.when(F.col("_inner"), 1).otherwise(0).cast("long").alias("d"), "n")
    links = stored(links)
    while True:
        ahead = links.where("p <> e").select(F.col("e").alias("_e"), F.col("p").alias("_p"), F.col("d").alias("_d"))
        moving = links.join(ahead, F.col("p") == F.col("_e"), "left")
        if moving.where("_e is not null").isEmpty():
            break
        links = stored(moving.select("e", F.coalesce("_p", "p").alias("p"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), "n"))
    tail = F.array_sort(F.collect_list(F.struct("d", f"e.h{longest}")))
    paths = links.groupBy("p").agg(tail.alias("_t"), F.max("n").alias("n")).select(
        F.concat(F.array(*[f"p.{h}" for h in _h(k)]), F.transform("_t", lambda x: x[f"h{longest}"])).alias("words"), "n")
    return paths, joined.where("not _inner").select(*_h(k), "n")


def along(paths: DataFrame, k: int, inside: bool = False) -> DataFrame:
    """Grams of ``k`` words on the paths, with the path's weight; ``inside`` leaves out the first and last."""
    i = 1 if inside else 0
    ways = F.size("words") - k + 1 - 2 * i
    at = F.explode(F.sequence(F.lit(1 + i), ways + i)).alias("_at")
    found = paths.where(ways > 0).select("words", "n", at)
    return found.select(*[F.element_at("words", (F.col("_at") + j).cast("int")).alias(h) for j, h in enumerate(_h(k))], "n")


def _exact(*factors: Column) -> Column:
    out = factors[0].cast("decimal(38,0)")
    for f in factors[1:]:
        out = (out * f.cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int | None = 2000,
            text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of phrases of 2 to ``longest`` words, best first per language.

    a is the phrase's count, l and r those of its two parts at the cut with the least score
    ``floor(10^6 a^2 / (l r))``, the first such cut on equal scores. A phrase inside a longer candidate that
    has at least ``percent`` of its count is dropped. ``top`` bounds the report, None gives all.
    """
    found = stored(flows(docs, longest, least, text, lang))
    counts = {1: found.where("level = 1").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= least)}
    for k in range(2, longest + 1):
        counts[k] = found.where(F.col("level") == k).select(*_h(k), "n")
    chosen = dict(counts)
    if longest > 2:
        paths, junctions = compacted(counts[longest], counts[longest - 1], longest)
        paths, junctions = stored(paths), stored(junctions)
        chosen[longest] = counts[longest] = along(paths, longest)
        counts[longest - 1] = junctions.unionByName(along(paths, longest - 1, inside=True))
        chosen[longest - 1] = junctions
    scored = None
    for m in range(2, longest + 1):
        rows = chosen[m].withColumnRenamed("n", "a")
        if m < longest:
            longer = counts[m + 1]
            part = lambda names: longer.select(*[F.col(c).alias(h) for c, h in zip(names, _h(m))], "n")
            around = part(_h(m)).unionByName(part(_h(m + 1)[1:])).groupBy(*_h(m)).agg(F.max("n").alias("_most"))
            rows = rows.join(around, _h(m), "left").where(
                F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * percent)).drop("_most")
        cuts = []
        for k in range(1, m):
            left = counts[k].withColumnRenamed("n", f"_l{k}")
            names = _h(m)[k:]
            right = counts[m - k].select(*[F.col(h).alias(x) for h, x in zip(_h(m - k), names)], F.col("n").alias(f"_r{k}"))
            rows = rows.join(left, _h(k)).join(right, names)
            score = F.expr("_up div _down")
            rows = rows.withColumn("_up", _exact(F.lit(1000000), F.col("a"), F.col("a"))).withColumn(
                "_down", _exact(F.col(f"_l{k}"), F.col(f"_r{k}"))).withColumn(f"_s{k}", score.cast("long")).drop("_up", "_down")
            cuts.append(F.struct(F.col(f"_s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
        best = F.array_min(F.array(*cuts)).alias("_b")
        words = F.array(*_h(m))
        one = rows.select(words.alias("words"), "a", best)
        scored = one if scored is None else scored.unionByName(one)
    scored = stored(scored.select(F.monotonically_increasing_id().alias("_k"), "words", "a", "_b.l", "_b.r", "_b.score"))
    names = found.where("level = 0").select("h1", "lang", "word")
    told = scored.select("_k", F.posexplode("words").alias("_at", "h1")).join(names, "h1").groupBy("_k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.first("lang").alias("lang"))
    totals = found.where("level = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    rows = scored.join(told, "_k").join(totals, "lang")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
