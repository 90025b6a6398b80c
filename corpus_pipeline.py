"""From raw documents to a mixed training corpus, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.common import stored, table
from likeness.llm.contamination import decontaminate
from likeness.llm.near_duplicates import one_of_each
from likeness.llm.site_quality import quality
from likeness.llm.source_mixing import mixed_corpus
from likeness.llm.surrogates import replace_entities


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``docs`` with another text; n_chars follows where the text changed."""
    n = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    new = {"text": text, "n_chars": n}
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality(docs, table(spark, sf_dir, "labels")).where("_keep").drop("_evidence", "_site_share", "_path_share", "_quality", "_keep")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return one_of_each(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark spans; a document of which more than half is benchmark text goes."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _with_text(found.where("_clean is not null or text is null"), F.col("_clean"), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    done = replace_entities(docs)
    n = F.when(F.col("_n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*(n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row per copy of a document, numbered by copy; the last copy may be its first words."""
    found = mixed_corpus(docs)
    return _with_text(found, F.col("_mixed"), [*docs.columns, "_copy"]).withColumnRenamed("_copy", "copy")


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_of_benchmarks),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]
#: The classifier, the signatures and the surrogates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
