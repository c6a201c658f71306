"""Plan rows, project listings and project lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import text


def _optional(condition, shown):
    return F.when(condition, F.concat(F.lit(" "), shown)).otherwise("")


def _setting(name: str, value, unit: str = ""):
    return F.concat(F.lit(f"[{name}="), value, F.lit(f"{unit}]"))


def build_plan(
    instances: DataFrame, edges: DataFrame, levels: DataFrame, members: DataFrame
) -> DataFrame:
    """Every selected instance with its settings, order and display line.

    ``instances`` are interpolated; ``levels`` comes from ``plan_levels`` and
    ``members`` from ``mark_finalizers``. Environment values are not shown. An
    instance without a level cannot be ordered, as it lies on a cycle or needs
    one that does; ``reason`` says so, and is null for all others.
    """
    node = ["project_id", "task_id"]
    deps = edges.groupBy(*node).agg(F.count("*").alias("dep_count"))
    rows = (
        members.join(instances, node)
        .join(levels.select(*node, "level"), node, "left")
        .join(deps, node, "left")
        .withColumn("dep_count", F.coalesce("dep_count", F.lit(0)))
        .withColumn("env_names", F.array_sort(F.map_keys("env")))
    )
    shown = F.concat(
        F.lit("would run "),
        "task_id",
        F.lit(" in "),
        "cwd",
        F.lit(": "),
        text.quote_command("command"),
        F.lit(" "),
        _setting("timeout", F.col("timeout_seconds"), "s"),
        F.lit(" "),
        _setting("max_output_bytes", F.col("max_output_bytes")),
        _optional(
            F.col("resource_group").isNotNull(),
            _setting("resource_group", F.coalesce("resource_group", F.lit(""))),
        ),
        _optional(F.size("inputs") > 0, _setting("inputs", F.array_join("inputs", ", "))),
        _optional(F.size("outputs") > 0, _setting("outputs", F.array_join("outputs", ", "))),
        _optional(F.col("retries") > 0, _setting("retries", F.col("retries"))),
        _optional(
            (F.col("retries") > 0) & (F.col("retry_backoff_seconds") > 0),
            _setting("retry_backoff", F.col("retry_backoff_seconds"), "s"),
        ),
        _optional(F.col("finalizer"), F.lit("[finally]")),
        F.array_join(
            F.transform(
                "env_names",
                lambda n: F.concat(F.lit(" [env "), n, F.lit(f"={schemas.REDACTED}]")),
            ),
            "",
        ),
    )
    reason = F.when(F.col("level").isNull(), "depends on a cycle")
    return rows.withColumn("line", shown).withColumn("reason", reason).drop("env", "matrix", "depends_on", "dims")


def list_projects(projects: DataFrame, tasks: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Listing lines per project, to be sorted by project_id, section, name.

    Rows instead of one document, so a project of any size stays distributed.
    """
    head = projects.select(
        "project_id",
        F.lit(0).alias("section"),
        F.col("project_id").alias("name"),
        F.concat(F.lit("project "), "project_name").alias("line"),
    )
    finally_part = F.when(
        F.size("finally") > 0,
        F.concat(F.lit("\n    finally: "), F.array_join("finally", ", ")),
    ).otherwise("")
    lanes = pipelines.select(
        "project_id",
        F.lit(1).alias("section"),
        F.col("pipeline").alias("name"),
        F.concat(
            F.lit("  "), "pipeline", F.lit(": "), F.array_join("tasks", ", "), finally_part
        ).alias("line"),
    )
    work = tasks.select(
        "project_id",
        F.lit(2).alias("section"),
        F.col("base").alias("name"),
        F.concat(F.lit("  "), "base", F.lit(": "), text.quote_command("command")).alias("line"),
    )
    return head.unionByName(lanes).unionByName(work)


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Nearest folder at or above each path that holds a manifest, or null."""
    segments = F.split("path", "/")
    folders = paths.select("path").distinct().select(
        "path", F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(segments)),
                lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"),
            )
        ).alias("depth", "root")
    )
    found = (
        folders.join(roots.select("root").distinct(), "root")
        .groupBy("path")
        .agg(F.max_by("root", "depth").alias("root"))
    )
    return paths.join(found, "path", "left")
