"""Token counts through a cache of digests.

A count belongs to a text and a tokenizer version. The cache is a table (digest of the content, tokens)
below a folder per version; the version digests the vocabulary file, the library and its release.
Documents join their digest to the stored counts; texts whose digest is not stored are brought
together once each, counted in Arrow batches and appended. Later runs count only new texts.

Where the vocabulary's pre-tokenizer always opens a token at a space, a text's count is the sum of its words' counts, and
the library counts a word once per task as long as there is room for it.

Content is normalised as far as no library tells two texts apart: a null text is the empty one, which has
no tokens and is never stored. Special strings inside a text follow the library's default, nothing is
added, cut or padded.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.common import small_batches, stored

CACHE = "digest binary, n_tokens long"
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 18
KNOWN_CHARS = 1 << 23       # of words whose counts a task remembers
TASKS = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
#: a space after another character always opens a new token of a byte-level pre-tokenizer
CUT = re.compile(r"(?<=\S)(?= )")


def tokenizer_version(path: str) -> str:
    """Digest of what decides a count: the file's bytes, the library and its release."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {importlib.metadata.version(library)} plain\n".encode())
    with open(path, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


def counter(path: str):
    """A function from a list of texts to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"        # one thread per task
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def lengths(texts):
        return [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    if not _cuttable(path):
        return lengths
    known: dict[str, int] = {}
    room = KNOWN_CHARS

    def count(piece):
        nonlocal room
        words = CUT.split(piece)
        fresh = list(set(words).difference(known))
        known.update(zip(fresh, lengths(fresh)))
        total = sum(map(known.__getitem__, words))
        room -= sum(map(len, fresh))
        if room < 0:
            known.clear()
            room = KNOWN_CHARS
        return total

    return lambda texts: [sum(map(count, _pieces(t))) for t in texts]


def _cuttable(path: str) -> bool:
    """May a text be counted word by word? Only where the file says that a space after another character is a border."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    plain = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    spaces = any(" " in t.get("content", "") for t in spec.get("added_tokens", []))
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and spec.get("normalizer") is None and plain and not spaces)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = CUT.search(text, start + PIECE_CHARS)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def cached(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored counts, one per digest, or None before the first append."""
    try:
        found = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    # Two runs may have appended the same text; its count is the same.
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with ``_n_bytes`` and ``_n_tokens``.

    ``tokenizer`` is a vocabulary file (.json or .model) that every executor can read, ``cache`` a shared
    folder. Repeated rows stay, copies are counted once, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    folder = f"{cache.rstrip('/')}/{tokenizer_version(tokenizer)}"
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    kept = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep]).alias("_row")
    rows = stored(docs.select(kept, F.octet_length(content).cast("long").alias("_n_bytes"), digest.alias("_digest")))

    wanted = rows.where("_n_bytes > 0").select(F.col("_digest").alias("digest")).distinct()
    known = cached(spark, folder)
    misses = wanted if known is None else stored(wanted.join(known, "digest", "left_anti"))
    if known is None or not misses.isEmpty():
        # Copies meet before the shuffle, so a text of which there are millions travels once per task.
        texts = docs.select(digest.alias("digest"), content.alias("content")).where("content <> ''").dropDuplicates(["digest"])
        if known is not None:
            texts = texts.join(misses, "digest", "left_semi")
        # Adaptive execution would merge them to about as many tasks as cores: a few more, and most cores wait for the last.
        before = spark.conf.get(TASKS, None)
        spark.conf.set(TASKS, 4 * spark.sparkContext.defaultParallelism)
        try:
            texts.mapInArrow(_encoder(tokenizer), CACHE).write.mode("append").parquet(folder)
        finally:
            spark.conf.unset(TASKS) if before is None else spark.conf.set(TASKS, before)
        known = cached(spark, folder)
    found = rows.join(known, F.col("_digest") == F.col("digest"), "left")
    return found.select("_row.*", "_n_bytes", F.when(F.col("_n_bytes") == 0, F.lit(0)).otherwise(F.col("n_tokens")).cast("long").alias("_n_tokens"))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts, counts, start, size = batch.column(1).to_pylist(), [], 0, 0
            for end, text in enumerate(texts):
                size += len(text)
                if size >= BATCH_BYTES or end == len(texts) - 1:
                    counts += count(texts[start:end + 1])
                    start, size = end + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run
