"""From raw documents to packed sequences: every stage works on all that the one before it kept.

Stages but the last return the columns of the documents that they get, in that order; where a stage changes texts, a
column ``n_chars`` is counted anew. They pass other columns through, whatever their names, and empty tables too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundcast.llm.common import stored, table
from roundcast.llm.decontaminate import decontaminate
from roundcast.llm.line_crf import THRESHOLD, score_documents
from roundcast.llm.line_runs import dedup_lines
from roundcast.llm.packing import pack
from roundcast.llm.simhash import without_near_duplicates

#: The classifier and, with ids alike, near-duplicate choice have no counterpart in SQL.
ORACLE_SQL = None


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "text")


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``: its own values, carried as c0, c1 ..., with the text in ``df``."""
    own = {c: F.col(f"c{i}") for i, c in enumerate(_others(docs))} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[own[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines score at least the threshold; texts without lines have the share of good labels."""
    scored = score_documents(docs, table(spark, sf_dir, "labels"), carry=_others(docs), keep_text=True)
    own = {c: F.col(f"c{i}") for i, c in enumerate(_others(docs))} | {"text": F.col("text")}
    return scored.where(F.col("score") >= THRESHOLD).select(*[own[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that consisted of nothing else goes."""
    done = dedup_lines(docs, carry=_others(docs))
    return _restored(done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, for each group of near-duplicates."""
    return without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; a document that is mostly benchmark goes."""
    return _restored(decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=_others(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences, with their token ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_copies),
    ("decontamination", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
