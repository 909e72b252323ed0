"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns what it reads back from the token
files.  ``run`` writes each result and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftscope.llm.decontamination import decontaminate
from driftscope.llm.langid import keep_identified
from driftscope.llm.mixing import mix
from driftscope.llm.near_copies import drop_near_copies
from driftscope.llm.scratch import Scratch, table
from driftscope.llm.tokens import token_files

#: of one of the public tokenizers, and the id that ends a document
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go: no text, or no letters in it."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted as often as the target of their source asks for."""
    return mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per emitted document."""
    import public_tokenizers

    return token_files(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token-ids", write_token_ids),
]

#: Suffix automata, fingerprints and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
