"""Mixing sources to target weights: whole copies, then Pareto order sampling for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.llm.common import stored, text_key

WORD = r"[^\x20\x09-\x0D]+"
LED_WORD = r"[\x20\x09-\x0D]*" + WORD      # a word and what stands before it
ROWS_PER_SLICE = 1000       # documents of a slice of the sampling order
U_BITS = 52


def word_count(text):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key, seed: str):
    """A number inside (0, 1) that depends on the key and the seed alone."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, U_BITS // 4), 16, 10).cast("long")
    return (digits.cast("double") + 0.5) / float(1 << U_BITS)


def source_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Targets per source of (skey, source, source_size, documents).

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` of all words. No
    target is above ``most`` times its source; the excess goes to the others by weight. Sources
    whose weight is largest for their size meet the limit first, so the limited ones are a prefix
    of that order and one running sum finds them.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    ordered = sources.select("*", weight.alias("weight"))
    steep = W.orderBy(F.when(F.col("source_size") > 0, F.try_divide("weight", "source_size")).desc_nulls_first(), "skey")
    rest = steep.rowsBetween(0, W.unboundedFollowing)
    before = steep.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * spent) / F.sum("weight").over(rest)
    tried = ordered.select("*", level.alias("level")).select(
        "*", (F.col("weight") * F.col("level") > F.lit(most) * F.col("source_size")).alias("limited"))
    final = F.min(F.when(~F.col("limited") & (F.col("source_size") > 0), F.struct(F.try_divide("weight", "source_size") * -1, "skey", "level"))).over(everything)["level"]
    return tried.select("skey", "source_size", "documents", F.when(
        F.col("limited") | (F.col("source_size") == 0), F.lit(most) * F.col("source_size"))
        .otherwise(F.least(F.col("weight") * final, F.lit(most) * F.col("source_size"))).alias("target"))


def _dealt(docs: DataFrame, kept: list[str], id_col: str, source_col: str, text_col: str,
           weights: tuple[float, ...], share: float, most: float, seed: str) -> DataFrame:
    """(row, size, source_size, target, taken) per input row; row holds the columns ``kept``."""
    rows = docs.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.col(source_col).cast("string").alias("source"),
                       word_count(text_col).alias("size"), text_key(F.col(text_col)).alias("h"),
                       uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed).alias("u"))
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source"))
    rows = stored(rows.select("*", skey.alias("skey")))
    sources = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                       F.count(F.lit(1)).alias("documents"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0)
    plan = source_targets(sources, list(weights), share, most).select("*", whole.cast("long").alias("whole"))
    plan = stored(plan.select("*", (F.round("target").cast("long") - F.col("whole") * F.col("source_size")).alias("sample"),
                              (F.try_divide("target", "source_size") - F.col("whole")).alias("chance")))
    # a document's random odds u / (1 - u) over its inclusion odds
    odds = F.try_divide(F.col("u") * (1 - F.col("chance")), (1 - F.col("u")) * F.col("chance"))
    slices = F.greatest(F.lit(1), F.floor(F.col("documents") / ROWS_PER_SLICE))
    # odds / (1 + odds) keeps the order and lies in (0, 1)
    placed = rows.join(plan, "skey").select("row", "skey", "size", "h", "source_size", "target", "whole", "sample",
                                            F.coalesce(odds / (1 + odds), F.lit(1.0)).alias("rank"), slices.alias("slices"))
    placed = placed.select("*", F.floor(F.col("rank") * F.col("slices")).alias("slice"))
    sums = placed.groupBy("skey", "slice").agg(F.sum("size").alias("words"), F.first("sample").alias("sample"))
    upto = F.sum("words").over(W.partitionBy("skey").orderBy("slice").rowsBetween(W.unboundedPreceding, 0))
    ends = (sums.select("skey", "slice", "sample", upto.alias("upto"), (upto - F.col("words")).alias("before"))
            .where("before < sample and upto >= sample").select("skey", F.col("slice").alias("end"), "before"))
    joined = placed.join(stored(ends), "skey", "left")
    early = joined.where("end is null or slice <> end").select(
        "row", "size", "source_size", "target", "whole",
        F.when(F.col("slice") < F.col("end"), F.col("size")).otherwise(0).cast("long").alias("drawn"))
    run = F.sum("size").over(W.partitionBy("skey").orderBy("rank", "h").rowsBetween(W.unboundedPreceding, 0))
    last = joined.where("slice = end").select(
        "row", "size", "source_size", "target", "whole",
        F.least(F.col("size"), F.greatest(F.lit(0), F.col("sample") - F.col("before") - (run - F.col("size")))).cast("long").alias("drawn"))
    return early.unionByName(last).select(
        "row", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("drawn")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Words that a mix takes of every document, so that each source reaches its target.

    One row per input row: the id, size (words), source_size, target (of the source) and taken. A
    source that is to give ``r`` times its words gives ``floor(r)`` whole copies of every document;
    the fraction left is the inclusion probability of each document in a fixed-size sample. It is
    drawn by Pareto order sampling: documents are ranked by their random odds divided by their
    inclusion odds, and taken in that order until the words of the sample are reached. The document
    in which they are reached gives the words still missing, so every source meets its rounded target.

    The order depends on id and seed alone, so reruns agree; ties follow the text. Sums along the
    order are taken over slices, and rows are ordered only inside the one slice per source in which
    the sample ends, so a source with a third of all rows is no group of its own anywhere. Null
    texts have size 0, null sources are a source of their own, null ids share one random number.
    """
    found = _dealt(docs, [id_col], id_col, source_col, text_col, weights, share, most, seed)
    return found.select(F.col("row")[id_col].alias(id_col), "size", "source_size", "target", "taken")


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                 weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: a row of ``docs`` for every copy that it takes, with _copy (from 0) and _mixed (its text).

    A row gives its whole text as often as the words taken by ``mix_sources`` allow, and in one more
    copy the first of its words, up to the end of the last one still to be given. Rows that give no
    word, such as null and blank texts, are left out. Input columns stay, but for those named like
    the added ones.
    """
    docs = docs.drop("_copy", "_mixed")
    found = _dealt(docs, docs.columns, id_col, source_col, text_col, weights, share, most, seed).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    found = found.select("row", whole.alias("whole"), rest.cast("int").alias("rest"))
    copies = F.sequence(F.lit(0), F.col("whole") + F.when(F.col("rest") > 0, 0).otherwise(-1))
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text, F.lit(LED_WORD), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("rest")), "")
    return (found.select("row", "whole", "rest", F.explode(copies).alias("_copy"))
            .select("row.*", "_copy", F.when(F.col("_copy") < F.col("whole"), text).otherwise(part).alias("_mixed")))
