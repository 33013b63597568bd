"""The corpus pipeline: documents in, a deduplicated, clean and mixed training set out, tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of documents. All of them take nulls in
any column, empty and very long texts, ties, repeated rows, empty tables and
further columns of any name; the functions that they call state what comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.common import stored, table
from gneiss.llm.decontaminate import clean_documents
from gneiss.llm.language import with_known_language
from gneiss.llm.mixing import mix_documents
from gneiss.llm.simhash import one_of_each
from gneiss.llm.token_files import token_files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter (null and empty ones too), or no language that is likelier than the others together, go; repeated rows share their fate."""
    return with_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays, one row of it; null ids come last; null and empty texts are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are benchmark passages go; without words, or without a benchmark, none does."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as their source's target says: not at all, once or twice. Null is a source; rows of one id share its copies in order of text and columns."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and a row for each document in them: a null text has its end only, copies are documents of their own, an empty table makes no files."""
    return token_files(spark, docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: SQL can express neither the tokenizer nor the trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
