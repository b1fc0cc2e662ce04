"""From raw documents to packed sequences: each stage works on all that its predecessor kept.

Toxic documents go, repeated lines go and the rest of their documents stays, one document of each group of near copies stays, documents that hold a
benchmark item go, and the rest is packed. All stages but the last return the columns of ``documents``, extra ones included,
whatever their names.

In all stages: null and empty texts are not toxic, have no lines, no near copies and no benchmark items, so they stay and
become the end id alone. Rows with a null id are kept by every filter but that for toxicity, which judges the text. Rows that
repeat an id are judged by their own texts for toxicity; line dedup takes places of one id and number as one place, near dedup
keeps or drops the rows of an id together, and so does decontamination. Whole texts count, however long. Of equal lines or
copies the one with the smallest id stays. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratamix.llm import decontaminate, linedup, neardup, packing, toxicity
from stratamix.llm.common import table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that score 0.5 or more by the labels of ids that are not held out."""
    return toxicity.without_toxic(docs, toxicity.labelled_fit(spark, sf_dir, docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; a document with nothing but blanks left goes as well."""
    return linedup.without_repeats(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near copies: five words, similarity 0.8."""
    return neardup.without_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the ids whose text holds an item of ``benchmark``."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Packing and scoring need Python; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
