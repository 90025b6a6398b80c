"""One registered query per operator, over whole tables, in the columns its contract names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.collocations import phrases
from likeness.llm.common import table
from likeness.llm.contamination import decontaminate, items_digest
from likeness.llm.conversation_repair import damaged, repair_all
from likeness.llm.host_trust import filter_urls
from likeness.llm.main_text import extract_main_text
from likeness.llm.near_duplicates import near_duplicates
from likeness.llm.repeated_spans import repeated_spans
from likeness.llm.site_quality import quality
from likeness.llm.source_mixing import mix_sources
from likeness.llm.surrogates import replace_entities
from likeness.llm.token_cache import token_counts
from likeness.llm.toxicity import toxicity
from likeness.llm.vector_duplicates import near_duplicate_vectors
from likeness.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_minhash_near_dedup(spark, sf):
    found = near_duplicates(table(spark, sf, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op1_suffix_array_dedup(spark, sf):
    return repeated_spans(table(spark, sf, "documents")).drop("kept")


@query
def op3_benchmark_decontamination(spark, sf):
    found = decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                        F.size("_items").cast("long").alias("n_items"), items_digest("_items").alias("items_sha256"),
                        (F.col("_n_hit") > 0).alias("contaminated"))


@query
def op7_source_mixing(spark, sf):
    return mix_sources(table(spark, sf, "documents"))


@query
def op9_embedding_near_dedup(spark, sf):
    return near_duplicate_vectors(table(spark, sf, "embeddings"))


@query
def op2_toxicity(spark, sf):
    found = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
                        F.col("_predicted").alias("predicted"))


@query
def op6_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return quality(docs, table(spark, sf, "labels")).select(
        "doc_id", F.col("_evidence").alias("evidence"), F.col("_site_share").alias("site_share"),
        F.col("_path_share").alias("path_share"), F.col("_quality").alias("quality"), F.col("_keep").alias("kept"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op4_url_filters(spark, sf):
    return filter_urls(table(spark, sf, "pages"), RULES)


@query
def op5_pii_surrogates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return replace_entities(docs).withColumnRenamed("_n_entities", "n_entities")


@query
def op10_html_extraction(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("_text").alias("text"), F.col("_n_chars").alias("n_chars"))


@query
def op11_conversation_repair(spark, sf):
    conversations = table(spark, sf, "conversations")
    return repair_all(conversations, damaged(conversations))


@query
def op12_token_counts(spark, sf):
    """The cache of one source folder lies in the shared folder, so another run over the same tables finds it."""
    import public_tokenizers

    cache = f"{checkpoint_dir(spark).rstrip('/')}/token-counts/{hashlib.md5(sf.encode()).hexdigest()}"
    found = token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache, keep=["doc_id"])
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"),
                        (F.col("_n_tokens") > 512).alias("over_limit"))


@query
def op13_phrase_collocations(spark, sf):
    return phrases(table(spark, sf, "documents"))
