"""From manifests to plans, problems and cache keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import fingerprint as fp
from runledger.operators import graph, lint, planning
from runledger.operators import matrix as mx
from runledger.session import settle


@dataclass
class ProjectGraph:
    """Instances and edges of all projects, and references that fail."""

    instances: DataFrame
    edges: DataFrame
    errors: DataFrame
    levels: DataFrame


def project_graph(tasks: DataFrame) -> ProjectGraph:
    """Expand, fill in and connect the tasks; each part is computed once."""
    instances = settle(mx.interpolate(mx.expand_matrix(tasks)), "instances")
    edges, errors = mx.resolve_edges(instances, tasks)
    edges = settle(edges, "edges")
    return ProjectGraph(instances, edges, errors, graph.task_levels(edges, instances))


def pipeline_roots(pipelines: DataFrame, tasks: DataFrame, column: str) -> DataFrame:
    """Instances a pipeline names in ``tasks`` or ``finally``."""
    references = pipelines.select(
        "project_id", "pipeline", F.explode(column).alias("ref"), mx.no_dims().alias("fixed")
    )
    known = tasks.select("project_id", "base", "matrix")
    return (
        mx.resolve_references(references, known)
        .where(F.col("error").isNull())
        .select("project_id", "pipeline", F.explode("targets").alias("task_id"))
    )


def plan_projects(built: ProjectGraph, tasks: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Plan rows of every pipeline of every project, in dependency-first order."""
    members = graph.mark_finalizers(
        built.edges,
        pipeline_roots(pipelines, tasks, "tasks"),
        pipeline_roots(pipelines, tasks, "finally"),
    )
    return planning.build_plan(built.instances, built.edges, built.levels, members)


def check_projects(projects: DataFrame, tasks: DataFrame, pipelines: DataFrame) -> DataFrame:
    """All problems of a fleet of manifests: project_id, subject, rule, detail."""
    return (
        lint.lint_fields(tasks, pipelines, projects)
        .unionByName(lint.lint_patterns(tasks))
        .unionByName(lint.lint_matrix(tasks))
        .unionByName(lint.lint_references(tasks, pipelines, projects))
    )


def key_projects(
    built: ProjectGraph, files: DataFrame, projects: DataFrame
) -> DataFrame:
    """Cache keys of all tasks that may be cached.

    ``projects``: project_id, platform, manifest_sha256, environment.
    """
    cacheable = fp.cacheable_tasks(built.instances, built.edges).where("cacheable")
    cacheable = settle(cacheable.drop("cacheable"), "cacheable")
    inputs = fp.exclude_outputs(fp.select_files(files, cacheable), cacheable)
    own = fp.own_fingerprint(
        cacheable,
        fp.input_digest(inputs),
        fp.select_environment(cacheable, projects),
        projects,
    )
    node = ["project_id", "task_id"]
    edges = built.edges.join(cacheable.select(*node), node, "left_semi")
    return fp.task_keys(own, edges, built.levels)
