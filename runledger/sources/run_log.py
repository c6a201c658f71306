"""Newline-delimited run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger import schemas


def _with_origin(raw: DataFrame) -> DataFrame:
    return raw.withColumn("source_file", F.col("_metadata.file_path"))


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and error documents found below ``path``.

    Both shapes share the files. Events carry ``event``; error documents carry
    ``kind`` instead and name no run, so both keep their source file. Lines that
    are neither are found by :func:`runledger.sources.rejects.malformed_lines`.
    """
    raw = _with_origin(
        spark.read.schema(schemas.RUN_LOG).option("recursiveFileLookup", True).json(path)
    )
    documents = raw.where(F.col("kind").isNotNull() & F.col("event").isNull()).select(
        "source_file", "schema", "kind", "code", "message"
    )
    return raw.where(F.col("event").isNotNull()), documents


def _event_columns(events: DataFrame) -> list[str]:
    names = T.StructType.fromDDL(schemas.RUN_LOG).names
    return [n for n in names if n in events.columns and n not in ("kind", "code", "message")]


def write_run_log(events: DataFrame, path: str, mode: str = "error", files: int | None = None) -> None:
    """One JSON object per event and line, in folders by ``run_date``.

    Null fields are left out, so every event only shows its own payload. With ``files``
    the lines are dealt by date to so many tasks, after all tasks have made them.
    """
    line = F.to_json(F.struct(*_event_columns(events)))
    lines = events.select("run_date", line.alias("value"))
    if files:
        lines = lines.repartitionByRange(files, "run_date")
    lines.write.mode(mode).partitionBy("run_date").text(path)
