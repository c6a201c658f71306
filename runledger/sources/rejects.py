"""Lines that the JSON readers cannot use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines below ``path`` that hold no JSON object: source_file, line, reason.

    The readers of run logs, manifests and machine documents pass over such
    lines; together with their results this accounts for every line. Blank lines
    are no records and are not reported.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line")
    )
    parsed = F.try_parse_json("line")
    reason = F.when(parsed.isNull(), "malformed JSON").when(
        ~F.schema_of_variant(parsed).startswith("OBJECT"), "no object"
    )
    return (
        lines.where(F.trim("line") != "")
        .select("source_file", "line", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )
