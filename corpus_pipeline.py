"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. Texts that lines were dropped from have their n_chars renewed; a document is removed
only by the quality rules, as a near copy of one that stays, or for a benchmark item in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontam, line_runs, near_copies, quality, sp_dropout
from quirework.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents leave every text."""
    done = line_runs.dedup(docs, out=("__kept", "__lines", "__dropped"))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("__kept")), "n_chars": F.char_length("__kept").cast("long")}
    return done.select(*[(F.when(F.col("__dropped") > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of five-word shingles in common) the document with the smallest id stays.
    SimHash fingerprints of these shingles propose the pairs, by an index of byte positions with count filtering; the shingles themselves verify them."""
    return near_copies.keep_first(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, with merge-dropout, in place of its text."""
    done = sp_dropout.encode(docs, out="__encoded")
    return done.select("doc_id", "lang", "source", "n_chars", F.col("__encoded.ids").alias("ids"), F.col("__encoded.lossless").alias("lossless"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Hashed features, fingerprints, edit distances and piece merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is a written table in the shared folder."""
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
