"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, mixture.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``. A stage's result
is written to the shared folder and read again as the next one's documents.

Defined results: null, empty and blank texts are judged by the classifier like others and are kept by every later stage that they reach. Rows with a null id are judged by the classifier and
leave with the near-duplicate stage, which keeps documents by their id; rows that repeat the id of a kept document all stay, and the passage stage removes nothing from them for being repeated.
An empty table goes through as an empty table. Other columns are kept, whatever their names, up to the mixture, which returns its schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinage.llm import decontaminate, minhash_dedup, quality_classifier, source_mixing, suffix_dedup
from vicinage.llm._store import load, table

#: Shingles of the near-duplicate stage, in words, and its least similarity in per cent.
SHINGLE_WORDS, SIMILARITY = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.fit(*quality_classifier.labelled_sample(docs, load(spark, sf_dir, "labels")))
    return quality_classifier.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    groups = minhash_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    return docs.join(groups.where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; texts of which nothing is left go. ``n_chars`` is counted anew."""
    return suffix_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training schedule: one row for each time that a document is read."""
    return source_mixing.mix(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: No SQL: the classifier is fitted, and repeated passages can't be cut in SQL within reason. tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
