"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import small_batches, stored, text_key

# Characters that look like Latin letters, and digits or signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ӏ": "i", "ԛ": "q", "ԝ": "w",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
SHORTEST, LONGEST = 3, 12    # letters of a learned stem
PRIOR_TEXTS = 3              # texts at the base rate that are added to those that hold a stem
_LOOKS = {**HOMOGLYPHS, "l": "i", **dict.fromkeys("​‌‍⁠﻿­", "")}     # no target is itself a key
_STANDS = str.maketrans(STAND_INS)
_SIGNED = re.compile(r"(?<![\w@$])[^\W\d]*+[\d@$][\w@$]*+")       # a whole word with a digit or sign in it
_STANDING = re.compile(r"(?<=[^\W_])[@$](?=\w)|\d")
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def _letters_for_digits(match: re.Match) -> str:
    word = match[0]
    return word.translate(_STANDS) if _LETTER.search(word) and _STANDING.search(word) else word


def fold(text: str) -> str:
    """Words of letters, each between spaces of its own; look-alikes, l and i, and stand-ins are one."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _SIGNED.sub(_letters_for_digits, text.lower())
    for looks in set(text) & _LOOKS.keys():
        text = text.replace(looks, _LOOKS[looks])
    return f" {'  '.join(_WORD.findall(text))} "


def _automaton(lexicon: dict[str, float]):
    out = ahocorasick.Automaton()
    for pattern, weight in lexicon.items():
        out.add_word(pattern, (pattern, weight))
    out.make_automaton()
    return out


def evidence(folded: str, automaton) -> float:
    """Weights of the longest matches, over a slowly growing function of the length in words.

    The nth match of one pattern adds less and less: n of them weigh 1 + log(n) times one.
    """
    if not len(automaton):
        return 0.0
    found = Counter(value for _, value in automaton.iter_long(folded))
    total = sum(weight * (1 + math.log(n)) for (_, weight), n in found.items())
    words = folded.count("  ") + 1
    return total / (1 + math.log1p(words / 1000))


def _stems(tokens: set[str]) -> set[str]:
    return {t[:k] for t in tokens for k in range(SHORTEST, min(LONGEST, len(t)) + 1)}


def _tokens(rows: DataFrame) -> DataFrame:
    """(token, stem, toxic, clean): in how many texts of either label each folded word or stem occurs."""
    def run(batches):
        counts: dict[tuple[str, bool], list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.bool_()),
                 pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())],
                names=["token", "stem", "toxic", "clean"])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {t[:64] for t in fold(text or "").split()}
                for key in [*((t, False) for t in words), *((t, True) for t in _stems(words))]:
                    counts.setdefault(key, [0, 0])[toxic] += 1
                if len(counts) > 200_000:
                    yield flush()
        if counts:
            yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "token string, stem boolean, toxic long, clean long")


def separate_stems(candidates: dict[str, tuple[int, int]], weights: dict[str, float]) -> list[str]:
    """All candidates but those that begin a kept one or that a kept one begins; the heaviest is kept."""
    kept: set[str] = set()
    begun: set[str] = set()
    for stem in sorted(candidates, key=lambda s: (-weights[s], -candidates[s][0], -len(s), s)):
        if stem not in begun and not any(stem[:k] in kept for k in range(SHORTEST, len(stem))):
            kept.add(stem)
            begun.update(stem[:k] for k in range(SHORTEST, len(stem)))
    return sorted(kept)


def joint_weights(held: dict[tuple[tuple[int, ...], int], int], prior: np.ndarray, start: float, spread: float = 1.0) -> np.ndarray:
    """Weights of stems that occur together, by a logistic model whose prior means are the weights of each alone.

    ``held`` counts texts by (stems, label). Stems that share label-1 texts keep their own weights,
    as these texts are explained anyhow; stems that stand alone in label-0 texts lose theirs.
    """
    cells = sorted(held)
    row = np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells])
    col = np.array([s for c in cells for s in c[0]], np.int64)
    label, count = np.array([float(c[1]) for c in cells]), np.array([float(held[c]) for c in cells])
    size = np.bincount(row, minlength=len(cells))
    bound = np.bincount(col, (count * (size + 1))[row], len(prior)) / 4 + 1 / spread**2     # over every curvature
    lift, weight = start, prior.copy()
    for _ in range(500):
        miss = count * (label - 1 / (1 + np.exp(-np.clip(lift + np.bincount(row, weight[col], len(cells)), -30, 30))))
        step = (np.bincount(col, miss[row], len(prior)) - (weight - prior) / spread**2) / bound
        new = np.maximum(weight + step, 0)
        rise = miss.sum() / ((count * (size + 1)).sum() / 4)
        moved = max(abs(rise), np.abs(new - weight).max(initial=0))
        lift, weight = lift + rise, new
        if moved < 1e-6:
            break
    return weight


def learn_lexicon(rows: DataFrame, support: float = 0.002, precision: float = 0.8) -> dict[str, float]:
    """Stems and words that mark label 1 in (text, toxic), with their weights; exceptions weigh 0.

    Candidates are beginnings of words in enough label-1 and few label-0 texts. All are kept, but for
    beginnings and extensions of a heavier one. A stem's weight is its log-odds over the base rate,
    shrunk where few texts hold it, and corrected in one model for the stems it stands beside. Words
    that begin with a kept stem but stand mostly in label-0 texts become exceptions. ``rows`` is a
    sample of bounded size.
    """
    totals = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    least = max(3, math.ceil(support * bad))
    counted = stored(_tokens(rows).groupBy("stem", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    fit = counted.where(F.col("stem") & (F.col("toxic") >= least) & (F.col("toxic") / bad * precision >= F.col("clean") / good * 4 * precision)
                        & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    candidates = {r["token"]: (r["toxic"], r["clean"]) for r in fit.toLocalIterator()}
    start = math.log(bad / good)
    alone = {}
    for stem, (toxic, clean) in candidates.items():
        share = (toxic + PRIOR_TEXTS * bad / (bad + good)) / (toxic + clean + PRIOR_TEXTS)
        alone[stem] = math.log(share / (1 - share)) - start
    kept = separate_stems(candidates, alone)
    at = rows.sparkSession.sparkContext.broadcast({stem: i for i, stem in enumerate(kept)})

    def incidence(batches):
        for batch in batches:
            out = [sorted({at.value[s] for s in _stems({t[:64] for t in fold(text or "").split()}) & at.value.keys()})
                   for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], names=["stems", "toxic"])

    held: dict[tuple[tuple[int, ...], int], int] = {}
    sets = rows.select("text", "toxic").mapInArrow(incidence, "stems array<int>, toxic int").groupBy("stems", "toxic").count()
    for r in sets.toLocalIterator():
        held[tuple(r["stems"]), int(r["toxic"])] = r["count"]
    weights = joint_weights(held, np.array([alone[stem] for stem in kept], float), start)
    chosen = {f" {stem}": float(weight) for stem, weight in zip(kept, weights, strict=True) if weight > 0}
    begins = rows.sparkSession.createDataFrame([(stem[1:],) for stem in chosen], "begin string")
    safe = counted.where(~F.col("stem") & (F.col("clean") > 1) & (F.col("clean") / good > F.col("toxic") / bad))
    cuts = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: F.substring("token", F.lit(1), k))
    safe = (safe.select("token", F.explode(F.array_distinct(cuts)).alias("begin"))
            .join(F.broadcast(begins), "begin").select("token").distinct())    # stems of a bounded sample
    return {**chosen, **{f" {r['token']} ": 0.0 for r in safe.toLocalIterator()}}


def fit_scale(values: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over counted values, by Newton steps with a weak prior."""
    a, b = -2.0, 0.5
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * values, -30, 30)))
        w = counts * p * (1 - p) + 1e-9
        g = np.array([(counts * (labels - p)).sum() - 1e-3 * a, (counts * (labels - p) * values).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-3, (w * values).sum()], [(w * values).sum(), (w * values * values).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             fit_rows: int = 40_000, threshold: float = 0.7, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with _score (0 to 1), _predicted, _weight (sum over length) and _held_out.

    Lexicon, weights and scale are learned from at most about ``fit_rows`` labelled rows, taken by a
    hash of the id, and never from rows whose crc32(id as text) modulo 3 is 1 (_held_out). Texts that
    are equal count once. ``exceptions`` are further phrases whose matches carry no weight.

    Null and empty texts have no matches and get the score of such texts; rows without id count as
    not held out and are not learned from; ids labelled twice take the larger label; without labels
    of both kinds every score is 0. Input columns stay, but for those named like the added ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_weight", "_score", "_predicted", "_held_out")
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held)
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    size = known.count()
    share = min(1.0, fit_rows / max(size, 1))
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # at most about fit_rows ids and labels: a proven bound
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
                  .groupBy(text_key("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    lexicon = learn_lexicon(rows)
    lexicon.update({fold(x): 0.0 for x in exceptions})
    shared = spark.sparkContext.broadcast(lexicon)
    tally: Counter = Counter()
    if lexicon:
        def measure(batches):
            automaton = _automaton(shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([round(min(evidence(fold(t or ""), automaton), 100.0), 1) for t in batch.column(0).to_pylist()]),
                     batch.column(1)], names=["x", "toxic"])
        for r in rows.mapInArrow(measure, "x double, toxic int").groupBy("x", "toxic").count().collect():
            tally[r["x"], r["toxic"]] = r["count"]
    a = b = 0.0
    if tally:
        cells = sorted(tally)
        a, b = fit_scale(np.array([x for x, _ in cells]), np.array([float(y) for _, y in cells]),
                         np.array([float(tally[c]) for c in cells]))
    names, fitted = docs.columns, bool(tally)
    at = names.index(text_col)

    def score(batches):
        automaton = _automaton(shared.value)
        for batch in batches:
            found = [evidence(fold(t or ""), automaton) for t in batch.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(a + b * np.array(found, float), -700, 700))) if fitted else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array(p)],
                                             names=[*names, "_weight", "_score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(score, f"{kinds}, _weight double, _score double").select(
        "*", (F.col("_score") >= threshold).cast("int").alias("_predicted"), held.alias("_held_out"))
