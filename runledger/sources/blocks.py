"""Records of large text files, numbered across the blocks that tasks read.

Spark cuts a file into blocks and reads each in one piece. Rows of a block get
consecutive ids as they are read, so a row's place in its block is its id less the
smallest of the block; the counts of the blocks before it do the rest. Only one row
for each block is summed up: no file is held in a row, and no row is moved or sorted
to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(location: Column) -> Column:
    return F.regexp_replace(location, r"/[^/]*\z", "")


def numbered_records(spark: SparkSession, path: str, separator: str = "\n", by_folder: bool = False) -> DataFrame:
    """``file, record_no, value`` of the files below ``path``, numbered from 0.

    ``separator`` is one character; nothing follows the last one of a file unless there
    is text. With ``by_folder`` the files of a folder, in the order of their names, are
    one text, and ``file`` is the folder.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True)
        .option("lineSep", separator)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("location"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            "value",
        )
    )
    blocks = rows.groupBy("location", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    file = _folder(F.col("location")) if by_folder else F.col("location")
    before = Window.partitionBy("file").orderBy("location", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.withColumn("file", file).select(
        "location", "block", "file", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_id")).alias("shift")
    )
    return rows.join(bases, ["location", "block"]).select(
        "file", (F.col("id") + F.col("shift")).cast("bigint").alias("record_no"), "value"
    )


def numbered_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """``file, line_no, line``: lines without their ends, numbered from 1."""
    return numbered_records(spark, path, "\n", by_folder).select(
        "file", (F.col("record_no") + 1).alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("line")
    )


def files_below(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """``file, size`` of the files below ``path``, also of empty ones; nothing is read from them."""
    location = F.col("_metadata.file_path")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        (_folder(location) if by_folder else location).alias("file"), F.col("_metadata.file_size").alias("size")
    )
    return sizes.groupBy("file").agg(F.sum("size").alias("size"))
