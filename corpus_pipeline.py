"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage works on all that the stage before kept. All but the last return the columns of documents;
``n_chars`` follows the text where line dedup shortens it.

Cases: null texts, empty ones and those without letters go in the first stage; a null doc_id is a document like others, first
in rank; rows that repeat a document end as one, by near-dedup; further columns are carried along; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import stash, table, unstash
from auditloom.llm.decontaminate import clean_documents
from auditloom.llm.langid import keep_identified
from auditloom.llm.line_dedup import dedup_lines
from auditloom.llm.simhash import keep_one_each
from auditloom.llm.packing import pack
from auditloom.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of no clear language, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (by fingerprints of five-word shingles, for a Jaccard similarity of 0.8) stays: the one of smallest doc_id."""
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Language ID, near-dedup and packing have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what passes between stages is written to the shared folder, and goes once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        kept = stash(stage(spark, docs, sf_dir), name)
        if n:
            unstash(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
