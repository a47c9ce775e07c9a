"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and its rows are the next one's docs.

quality classifier, line dedup, MinHash near-dedup, PII, packing. All but the last return the columns of documents;
where a text changes, n_chars follows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stage, table
from factloom.llm.line_dedup import drop_repeated_lines
from factloom.llm.near_dup import drop_near_duplicates
from factloom.llm.packing import pack
from factloom.llm.pii import redact
from factloom.llm.quality_classifier import classify_quality

#: Near copies of the pipeline. A pair at this threshold meets in no band about once in 200,000.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 31, 5


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row beside them, so that no column of docs clashes with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def retold(found: DataFrame, columns: list[str]) -> DataFrame:
    """The carried columns with the new text, n_chars counted anew."""
    told = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*[told.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify_quality(carried(docs)).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one document's; no document goes."""
    return retold(drop_repeated_lines(spark, carried(docs)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; of rows with equal id and text one.

    A row goes only when its text is a copy, whether its doc_id is null or has other texts too.
    """
    return drop_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the names of its kinds."""
    return retold(redact(carried(docs)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: A trained scorer and trees decide in three stages and the last counts a tokenizer's ids: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
