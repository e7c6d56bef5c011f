"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sslspark.llm import langid, lines, mixing, packing, simhash
from sslspark.llm.common import stored
from sslspark.llm.queries import MIX_POWER, tokenizer_path
from sslspark.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose language it rejects go."""
    found = langid.predict(docs, langid.fit(docs))
    return found.where("NOT rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of lines within a few edits of each other the first stays.
    Texts get shorter; a document that has no line left stays, empty."""
    return lines.dedup_lines(docs, exact_chars=lines.EXACT_CHARS).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents sampled by calibrated probabilities."""
    return mixing.mix(docs, MIX_POWER).where("kept").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: windows of 1024 tokens, a row for each piece of a document."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Compression sizes, edit joins and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
