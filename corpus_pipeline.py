"""A training-data pipeline over `documents`, built from the corpus operators.

Each stage takes what its predecessor kept and returns the columns of `documents`; the
last returns packed token sequences. Every stage's result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widegrain.llm.common import save, table
from widegrain.llm.language_id import identified
from widegrain.llm.line_dedup import dedup_blocks
from widegrain.llm.packing import pack
from widegrain.llm.pii import replace_pii, session_key
from widegrain.llm.shingle_dedup import shingle_keep_first


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of `docs`, with n_chars, if it is there, counted again."""
    return changed.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it where it was null; the others go."""
    return identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that earlier ones have."""
    return _with_text(docs, dedup_blocks(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash candidates and those that it misses,
    linked at a Jaccard similarity of five-word shingles of 0.8 or more."""
    return shingle_keep_first(docs, shingle=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates."""
    return _with_text(docs, replace_pii(docs, session_key(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of at most 1024 tokens, with their ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A trained network, keyed surrogates and a packing order can't be said in SQL; tests hold
#: the rows of run() against a plain version of every stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
