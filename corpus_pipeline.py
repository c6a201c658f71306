"""A training corpus from raw documents, stage by stage.

Every stage takes the documents that the one before kept, and its decisions take
effect; the last returns the token ids of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from runledger.llm.queries import TOKENIZER
from runledger.session import passing_tables, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, row by row; null and empty texts go.

    Repeated rows share their verdict, further columns stay, an empty table gives none.
    """
    return quality_rules.keep_good(docs)


def apply_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat; ``n_chars`` follows the text.

    A row without id keeps its text; a null text becomes an empty one. Rows of one id
    count as one document; repeated rows, further columns and empty tables stay as they are.
    """
    kept = line_dedup.dedup_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    column = lambda c: F.col(f"row.`{c.replace('`', '``')}`")
    return kept.select(*[changed.get(c, column(c)).alias(c) for c in docs.columns])


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates.

    Rows without id cannot be named and stay, as do all rows of an id that stays; texts
    without words are like no other. Further columns stay, an empty table gives no rows.
    """
    return near_dedup.keep_one_per_class(docs)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Each row is decided by its own text, whatever its id. Null and empty texts hold no
    item; further columns stay, an empty table gives no rows.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def apply_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text, row by row; a null text is empty."""
    return bpe.digests(bpe.encode_decode(docs, TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", apply_line_dedup),
    ("near_dedup", apply_near_dedup),
    ("decontamination", apply_decontamination),
    ("encoding", apply_encoding),
]

#: SQL cannot express sketches, and no encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it.

    Tables that a stage stores on its way are deleted once its result is written.
    What nulls, repeated rows and further columns become is told stage by stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing_tables(spark):
            docs = settle(stage(spark, docs, sf_dir), f"corpus-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
