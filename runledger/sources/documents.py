"""Machine documents: plan, graph and list, told apart by ``kind``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import ordered


#: Tasks or pipelines in one line of a document; longer documents have more lines.
LINE_ITEMS = 256


def read_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rows of the documents below ``path``, keyed by kind.

    ``plan``: one row per task, with the pipeline and its place in the plan; plans that
    name no pipeline are told apart by ``source_file``. ``graph``: one row per
    dependency, or one with a null ``dep_id`` for a task without any. ``list``: one row
    per task, ``pipelines``: one per pipeline, ``projects``: one per project of the list
    documents, also of a project that has neither. ``others``: documents of another
    schema or kind, which have no rows elsewhere.

    A document may be one line or, as the writers here leave it, several that each hold
    some of its items.
    """
    raw = spark.read.schema(schemas.DOCUMENT).json(path).withColumn("source_file", F.col("_metadata.file_path"))
    version = F.coalesce(F.col("schema") == schemas.EVENT_SCHEMA_VERSION, F.lit(False))
    known = version & F.coalesce(F.col("kind").isin("plan", "graph", "list"), F.lit(False))

    def of(kind: str) -> DataFrame:
        return raw.where(known & (F.col("kind") == kind))

    first = F.coalesce("first", F.lit(0).cast("bigint"))
    plan = of("plan").select(
        "source_file", "project", "root", "pipeline", first.alias("first"), F.posexplode("tasks").alias("i", "t")
    ).select("source_file", "project", "root", "pipeline", (F.col("first") + F.col("i")).alias("plan_pos"), "t.*")
    graph = (
        of("graph")
        .select("project", "root", F.explode("edges").alias("e"))
        .select(
            "project", "root", F.col("e.task").alias("task"),
            F.posexplode_outer("e.depends_on").alias("dep_pos", "dep_id"),
        )
    )
    head = ["project", "root", "default_pipeline"]
    listing = of("list").select(*head, F.explode("tasks").alias("t")).select(*head, "t.id", "t.command", "t.stdin")
    lanes = of("list").select("project", "root", F.explode("pipelines").alias("p")).select("project", "root", "p.*")
    return {
        "plan": plan,
        "graph": graph,
        "list": listing,
        "pipelines": lanes,
        "projects": of("list").select(*head).distinct(),
        "others": raw.where(~known & (F.col("schema").isNotNull() | F.col("kind").isNotNull())).select(
            "source_file", "schema", "kind", "project", "root"
        ),
    }


def _in_lines(rows: DataFrame, group: list[str], order: list[str], item: Column, name: str) -> DataFrame:
    """``group, first, name``: the items of each group in order, some in each row.

    Places in the group are found block by block, so a group of any size is spread
    over its rows and no row holds more than :data:`LINE_ITEMS`.
    """
    placed = ordered.position_by_range(rows.select(*group, *order, item.alias("item")), group, order, "place")
    line = F.expr(f"place div {LINE_ITEMS}").alias("line")
    return placed.groupBy(*group, line).agg(
        F.min("place").alias("first"),
        F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias(name),
    ).drop("line")


def write_graph_documents(edges: DataFrame, tasks: DataFrame, path: str) -> None:
    """Graph documents, one JSON line per task."""
    node = ["project_id", "task_id"]
    lists = (
        edges.groupBy(*node)
        .agg(F.array_sort(F.collect_list(F.struct("dep_pos", "dep_id"))).alias("deps"))
        .select(*node, F.transform("deps", lambda d: d["dep_id"]).alias("depends_on"))
    )
    bare = (
        tasks.select(*node)
        .join(edges.select(*node), node, "left_anti")
        .withColumn("depends_on", F.array().cast("array<string>"))
    )
    document = lists.unionByName(bare).select(
        F.lit(schemas.EVENT_SCHEMA_VERSION).alias("schema"),
        F.lit("graph").alias("kind"),
        F.col("project_id").alias("project"),
        F.concat(F.lit("/"), "project_id").alias("root"),
        F.array(F.struct(F.col("task_id").alias("task"), "depends_on")).alias("edges"),
    )
    document.write.json(path)


def _head(kind: str, project: Column) -> list[Column]:
    return [
        F.lit(schemas.EVENT_SCHEMA_VERSION).alias("schema"),
        F.lit(kind).alias("kind"),
        project.alias("project"),
        F.concat(F.lit("/"), "project_id").alias("root"),
    ]


def write_plan_documents(plan: DataFrame, edges: DataFrame, path: str) -> None:
    """Plan documents of every project and pipeline, tasks in plan order.

    ``plan`` comes from ``build_plan``. A document is one JSON line for each
    :data:`LINE_ITEMS` tasks; ``first`` is the place of a line's first task. Tasks without a
    level have no place in an order and are left out.
    """
    node = ["project_id", "task_id"]
    needs = edges.groupBy(*node).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dep_pos", "dep_id"))), lambda d: d["dep_id"]
        ).alias("depends_on")
    )
    fields = [
        "command", "cwd", "stdin", "cache", "inputs", "outputs", "cache_env", "timeout_seconds",
        "max_output_bytes", "resource_group", "retries", "retry_backoff_seconds", "finalizer",
    ]
    task = F.struct(
        F.col("task_id").alias("id"),
        *fields,
        F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"),
        F.col("env_names").alias("env"),
    )
    rows = plan.where(F.col("level").isNotNull()).join(needs, node, "left")
    lines = _in_lines(rows, ["project_id", "pipeline"], ["level", "task_id"], task, "tasks")
    lines.select(*_head("plan", F.col("project_id")), "pipeline", "first", "tasks").write.json(path)


def write_list_documents(
    projects: DataFrame, tasks: DataFrame, pipelines: DataFrame, path: str
) -> None:
    """List documents of every project: its pipelines, tasks and commands.

    A document is a line that names the project, and one for each :data:`LINE_ITEMS`
    tasks and pipelines.
    """
    task = F.struct(F.col("base").alias("id"), "command", "stdin")
    lane = F.struct(F.col("pipeline").alias("name"), "tasks", "finally")
    lines = (
        projects.select("project_id")
        .unionByName(_in_lines(tasks, ["project_id"], ["base"], task, "tasks"), True)
        .unionByName(_in_lines(pipelines, ["project_id"], ["pipeline"], lane, "pipelines"), True)
    )
    documents = lines.join(projects.select("project_id", "project_name", "default_pipeline"), "project_id")
    documents.select(
        *_head("list", F.col("project_name")), "default_pipeline", "pipelines", "tasks"
    ).write.json(path)
