"""From raw documents to packed training sequences.

Stages take (spark, docs, sf_dir) and return a DataFrame.  All but the last return the
columns of documents; whatever a stage rejects or cuts is gone for the next ones.  Cases
(nulls, empty and very long texts, repeated rows, empty tables, other columns) are those
of the operators, named in their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import line_dedup, mixing, ngram_quality, packing, shingle_dedup
from graphloom.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    return ngram_quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates."""
    return line_dedup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash prints that meet at an anchor, Jaccard similarity of five-word shingles of 0.8 or more."""
    return shingle_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_recurring_lines),
    ("simhash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier's training, fingerprints, Newton steps and the tokenizer have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(spark, docs)
    return docs
