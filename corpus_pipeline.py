"""From raw documents to token ids: five stages, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns what is left of docs, with the columns of documents; the last one
returns token counts and digests of ids and decoded texts. Stages keep the rules of their operators: a null text is an
empty one, rows with a null id pass like any other (in near dedup they are one document), repeated rows are judged alike,
columns beyond those of documents pass through until the last stage, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontamination, line_dedup, near_dedup, quality
from marginalia.llm.common import Scratch, table


#: Similarity in percent from which documents are near-duplicates.
NEAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).filter("predicted = 1").select(docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, except from one of them; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, from a similarity of 0.8 on, the document with the smallest id stays."""
    return near_dedup.near_duplicates(docs, percent=NEAR).filter("kept").select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text that is left, encoded and decoded."""
    coded = bpe.encode(docs, digest=True)
    about = [c for c in ("doc_id", "lang", "source") if c in coded.columns]
    return coded.select(*about, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", own_lines),
    ("near dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can say neither the classifier nor the tokenizer; tests hold the stages against brute-force versions, the
#: tokenizers library, and the classifier against its own model row by row and the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:  # the table of a stage goes when the next is written
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
