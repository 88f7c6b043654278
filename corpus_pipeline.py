"""From raw documents to token shards: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Rows that repeat an id are judged alike by near-dedup and the
mix and one by one by the other stages; rows without an id pass every stage that their text passes.
An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.llm import decontaminate, language, minhash, mixing, tokens
from patronage.llm.queries import TOKENIZER, fresh_folder
from patronage.llm.texts import table
from patronage.session import settle, shipped


@shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a sufficient margin."""
    return language.accepted_documents(docs, language.learn(docs))


@shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of the five-word shingles: the smallest id."""
    copies = minhash.near_duplicates(docs, shingle=5, percent=80).filter("not kept")
    return docs.join(copies.select("doc_id").distinct(), "doc_id", "left_anti") \
        .select(*[f"`{c}`" for c in docs.columns])


@shipped
def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents to the target weights of their sources, one row per repeat."""
    return mixing.mixed_documents(docs)


@shipped
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' documents: place, length and checksum of their ids."""
    path = fresh_folder(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, TOKENIZER)
    return tokens.read_tokens(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("source_mix", mix_sources),
    ("token_output", write_token_ids),
]

# Compression, signatures and byte-pair merges are beyond SQL; tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
