"""A corpus pipeline of five stages, each one operator of the llm subpackage.

``run`` applies the stages to the documents of a folder; each stage's result is written as Parquet
in the shared folder and read again as the next one's documents.

Cases: documents with a null, empty or letterless text go in the first stage, which recognises no
language in them. Texts of any length are read whole. Rows alike in text are near duplicates of one
another: one stays. Null ids and sources are ids and sources of their own. Extra columns of any name
keep their values up to the last stage, which returns its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, langid, mixing, near_dedup, pii
from quernstone.llm.queries import VOCABULARY
from quernstone.llm.shared import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; ``lang`` becomes the one recognised."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = langid.identify(docs.select(row, F.col("text")), langid.fit(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*((F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by marks."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the mix of sources draws: stretches of documents, as often as they are taken."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document of the mix: its token ids, packed, and whether they decode to its text."""
    back = bpe.round_trip(docs, VOCABULARY)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", tokens)]

#: Sketches, trees and permutations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, "pipeline")
    return docs
