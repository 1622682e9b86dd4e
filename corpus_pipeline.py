"""Corpus pipeline: five stages over ``documents``, each an operator of the llm package.

1. toxicity: a model learned from the labels scores every text; texts of 0.3 or more go,
   the bound at which op6 calls a text toxic.
2. simhash_copies: of each class of fingerprints (4-word shingles, linked within 4 bits)
   the row with the least id stays.
3. decontamination: texts that hold a window of a benchmark item go.
4. secrets: every secret found is replaced by a mark; n_chars follows the text.
5. tokens: texts are encoded and decoded again; the result has ids instead of texts.

Every stage is written as Parquet below the shared folder and read by the next one. A
null text is an empty one throughout: it is not toxic, it is a copy of other empty texts,
it holds no window and no secret, and it has no tokens. Extra columns of the documents
stay up to the last stage, whatever their names: they travel packed, so no operator sees
them. SQL can express neither a learned score nor the tokenizer, so there is no
ORACLE_SQL; the tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm import bpe, decontaminate, secrets, simhash, toxicity
from shopgrain.session import stored

MAX_TOXICITY = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of documents, with all others in one column ``rest``."""
    others = [c for c in docs.columns if c not in COLUMNS]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []
    return docs.select(*COLUMNS, *rest)


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in its order."""
    return packed.select(*(F.col(c) if c in COLUMNS else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = _packed(docs)
    model = toxicity.learn(packed, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(packed, model, out="toxicity")
    return _unpacked(scored.where(F.col("toxicity") < MAX_TOXICITY), docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_copies(docs, shingle=4, budget=4)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_packed(docs), _table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where("n_hit = 0"), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = secrets.mask(secrets.find(_packed(docs)))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    hit = (F.size("spans") > 0) & F.col("text").isNotNull()
    return _unpacked(hidden.withColumn("n_chars", F.when(hit, length).otherwise(F.col("n_chars"))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(docs.select(*COLUMNS), path), path)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("toxicity", not_toxic),
    ("simhash_copies", first_copies),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
