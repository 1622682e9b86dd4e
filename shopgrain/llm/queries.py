"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm import (
    bpe,
    decontaminate,
    importance,
    jaccard,
    kneser_ney,
    quality,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
    whitening,
)
from shopgrain.llm.oracle import ORACLE
from shopgrain.session import stored

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_radix_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated(table(spark, folder, "documents")))


def op2_seekable_bundles(spark: SparkSession, folder: str) -> DataFrame:
    bundles = stored(warc.write_bundles(warc.with_first(table(spark, folder, "pages"))), "warc")
    return warc.read_bundles(bundles, payload=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_trie_join(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"), shingle=4, budget=4)
    return found.withColumn("fingerprint", simhash.hex_fingerprint())


def op4_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op5_transducer_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.digest(bpe.decode(encoded, path))


def op6_clause_grammar(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op7_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"), shards=24).select("doc_id", *sharding.PLACE)


def op8_prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find(docs, table(spark, folder, "benchmark"), window=10))


def op9_keyword_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, folder, "documents").select("doc_id", "text")))


def op10_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    held_out = toxicity.held_out(parts=5, out=1)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(~held_out), order=3)
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), *kneser_ney.OUT)


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return importance.resample(docs, target, percent=10, min_words=20, buckets=10_000)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"), components=4)
    # Null where it does not fit, which takes some hundred million vectors.
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_token_groups(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"), shingle=4, percent=85)


QUERIES: dict[str, Query] = {
    "op1_radix_suffixes": op1_radix_suffixes,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_groups": op13_token_groups,
    "op2_seekable_bundles": op2_seekable_bundles,
    "op3_trie_join": op3_trie_join,
    "op4_distribution_divergence": op4_distribution_divergence,
    "op5_transducer_lexicon": op5_transducer_lexicon,
    "op6_clause_grammar": op6_clause_grammar,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_prefix_filter": op8_prefix_filter,
    "op9_keyword_automaton": op9_keyword_automaton,
}
