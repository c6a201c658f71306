"""Project manifests as JSON documents, one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas


def _or(column: str, default: Column) -> Column:
    return F.coalesce(F.col(column), default)


def _strings(column: str) -> Column:
    return _or(column, F.array().cast("array<string>"))


def read_manifests(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, tasks and pipelines of all manifests below ``path``.

    Absent fields get their defaults. The document key ``project_id`` tells the
    manifests of a fleet apart.
    """
    raw = spark.read.schema(schemas.MANIFEST).json(path)
    projects = raw.where(F.col("project").isNotNull()).select(
        "project_id",
        _or("schema", F.lit(schemas.MANIFEST_SCHEMA_VERSION)).cast("bigint").alias("schema"),
        F.col("project.name").alias("project_name"),
        _or("project.default_pipeline", F.lit(schemas.DEFAULT_PIPELINE)).alias("default_pipeline"),
    )
    task = raw.select("project_id", F.explode("tasks").alias("base", "t")).select(
        "project_id", "base", "t.*"
    )
    tasks = task.select(
        "project_id",
        "base",
        *[
            _strings(name).alias(name)
            for name in ("command", "depends_on", "inputs", "outputs", "cache_env")
        ],
        "cwd",
        _or("env", F.create_map().cast("map<string,string>")).alias("env"),
        _or("stdin", F.lit("null")).alias("stdin"),
        _or("cache", F.lit(False)).alias("cache"),
        _or("timeout_seconds", F.lit(schemas.DEFAULT_TIMEOUT_SECONDS))
        .cast("bigint").alias("timeout_seconds"),
        _or("max_output_bytes", F.lit(schemas.DEFAULT_MAX_OUTPUT_BYTES))
        .cast("bigint").alias("max_output_bytes"),
        "resource_group",
        _or("retries", F.lit(0)).cast("bigint").alias("retries"),
        _or("retry_backoff_seconds", F.lit(0)).cast("bigint").alias("retry_backoff_seconds"),
        _or("matrix", F.create_map().cast("map<string,array<string>>")).alias("matrix"),
    )
    lane = raw.select("project_id", F.explode("pipelines").alias("pipeline", "l"))
    pipelines = lane.select(
        "project_id", "pipeline", _strings("l.tasks").alias("tasks"),
        _strings("l.finally").alias("finally"),
    )
    return projects, tasks, pipelines


def write_manifests(
    projects: DataFrame, tasks: DataFrame, pipelines: DataFrame, path: str
) -> None:
    """Manifest documents, one JSON line per task, pipeline and project head.

    A document may be split over several lines of the same ``project_id``;
    readers treat the lines of a project as one manifest. So a project of any
    size can be written without gathering it in one place.
    """
    head = projects.select(
        "project_id", "schema",
        F.struct(F.col("project_name").alias("name"), "default_pipeline").alias("project"),
    )
    task_columns = [c for c in schemas.TASK_KEYS if c in tasks.columns]
    task_lines = tasks.select(
        "project_id", F.create_map("base", F.struct(*task_columns)).alias("tasks")
    )
    lane_lines = pipelines.select(
        "project_id", F.create_map("pipeline", F.struct("tasks", "finally")).alias("pipelines")
    )
    lines = head.unionByName(task_lines, True).unionByName(lane_lines, True)
    lines.write.json(path)
