"""Preparation of a training corpus: five stages, each over all that the stage before kept.

1. quality rules: documents that fail the base rules or a risk-controlled cutoff go
2. n-gram Jaccard join: of each class of near-duplicates the document of smallest id stays
3. personal data: spans are replaced by class words, terms that disclose them generalised or removed
4. mixing: each source is repeated or cut to its target
5. byte-level BPE: texts become token ids, checked by decoding them

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import bpe, mixing, ngram_jaccard, pii, quality_rules
from keyspan.llm.common import shared_folder

# Near-duplicates share four fifths of their five-word n-grams.
NEAR = ngram_jaccard.Join(n=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each_class(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text (they always do)."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_and_compare(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

# The mix depends on 64-bit hashes and the tokens on a merge table, which DuckDB's SQL cannot express; the stages are
# tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        result.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
