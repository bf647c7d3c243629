"""Corpus pipeline over documents: toxic texts go, one of each group of near-duplicates stays, personal data gets
pseudonyms, sources are mixed to target weights, and the mixture is encoded for training.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last
return the columns of documents. Every stage's rows are written as Parquet and read by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.frames import load, stored
from tablewright.llm.mixture import drawn_texts, mixture, sized_documents, source_targets
from tablewright.llm.neardup import without_near_duplicates
from tablewright.llm.pieces import encode_texts
from tablewright.llm.pseudonyms import pseudonymised
from tablewright.llm.toxicity import fit_toxicity, held_out, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels that are not held out, doesn't reject."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    return score_toxicity(docs, fit_toxicity(docs, labels), keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return without_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture draws of each document, a row for each pass."""
    sized = sized_documents(docs)
    drawn = stored(mixture(sized, stored(source_targets(sized), "targets")), "drawn")
    return drawn_texts(docs, drawn).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text."""
    return encode_texts(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

# Learned weights, iterated components and suffix arrays are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
