"""Checks for matrix, planning and lint operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import with_views
from runledger.operators import events as ev
from runledger.operators import graph, lint, planning
from runledger.operators import matrix as mx
from runledger.plans import project_plan
from runledger.session import scratch_path, settle
from runledger.sources import documents, manifests


def _text(values: str | Column) -> Column:
    return F.array_join(values, "|")


def _dims_text(dims: Column) -> Column:
    return F.array_join(F.transform(dims, lambda d: F.concat(d["key"], F.lit("="), d["value"])), "|")


def s2_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifests")
    manifests.write_manifests(
        views.projects(spark, sf_dir), views.tasks(spark, sf_dir), views.pipelines(spark, sf_dir), path
    )
    _, tasks, _ = manifests.read_manifests(spark, path)
    return tasks.select(
        "project_id", "base", _text("command").alias("command"), "cwd", "stdin", "cache",
        "timeout_seconds", "max_output_bytes", "retries",
        F.size("matrix").cast("bigint").alias("n_dims"),
        F.col("env")["LEVEL"].alias("env_level"),
        *[_text(c).alias(c) for c in ("depends_on", "inputs", "outputs", "cache_env")],
        "resource_group", "retry_backoff_seconds",
        _text(F.transform(
            F.array_sort(F.map_entries("matrix")),
            lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")),
        )).alias("matrix"),
    )


def s2_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and pipelines of the manifests, read back."""
    path = scratch_path(spark, "manifests")
    manifests.write_manifests(
        views.projects(spark, sf_dir), views.tasks(spark, sf_dir), views.pipelines(spark, sf_dir), path
    )
    projects, _, pipelines = manifests.read_manifests(spark, path)
    return projects.select(
        "project_id", F.lit("project").alias("part"), F.col("project_name").alias("name"),
        F.col("schema").cast("string").alias("first"), F.col("default_pipeline").alias("second"),
    ).unionByName(pipelines.select(
        "project_id", F.lit("pipeline").alias("part"), F.col("pipeline").alias("name"),
        _text("tasks").alias("first"), _text("finally").alias("second"),
    ))


def s3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    documents.write_graph_documents(
        views.edges(spark, sf_dir), views.graph_nodes(spark, sf_dir), path
    )
    edges = documents.read_documents(spark, path)["graph"]
    return edges.select("project", "task", F.col("dep_pos").cast("string").alias("dep_pos"), "dep_id")


def s3_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List documents, written and read back: tasks, pipelines and projects, also one without any."""
    path = scratch_path(spark, "lists")
    projects, tasks, lanes = (f(spark, sf_dir) for f in (views.projects, views.tasks, views.pipelines))
    bare = projects.limit(1).withColumns({"project_id": F.lit("bare"), "project_name": F.lit("bare")})
    documents.write_list_documents(
        projects.unionByName(bare.withColumn("default_pipeline", F.lit("ci"))), tasks, lanes, path
    )
    read = documents.read_documents(spark, path)
    part = lambda kind: F.lit(kind).alias("part")
    return (
        read["list"]
        .select("project", "root", part("task"), F.col("id").alias("name"), _text("command").alias("first"),
                F.col("stdin").alias("second"))
        .unionByName(read["pipelines"].select(
            "project", "root", part("pipeline"), "name", _text("tasks").alias("first"), _text("finally").alias("second")))
        .unionByName(read["projects"].select(
            "project", "root", part("project"), F.lit("").alias("name"), F.col("default_pipeline").alias("first"),
            F.lit("").alias("second")))
    )


def s3_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan documents of two pipelines of each project, written and read back; ``other`` is of a later schema."""
    path = scratch_path(spark, "plans")
    plan, edges = _plan(spark, sf_dir)
    plan = settle(plan, "plan-rows")
    both = plan.unionByName(plan.where(F.length("task_id") % 2 == 0).withColumn("pipeline", F.lit("even")))
    documents.write_plan_documents(both, edges, f"{path}/now")
    spark.range(3).select(F.lit(9).alias("schema"), F.lit("plan").alias("kind"), F.lit("later").alias("project")).write.json(
        f"{path}/later"
    )
    read = documents.read_documents(spark, f"{path}/*")
    return read["plan"].select(
        "project", "pipeline", F.col("plan_pos").cast("bigint").alias("plan_pos"), F.col("id").alias("task"),
        _text("depends_on").alias("depends_on"), "finalizer",
    ).unionByName(read["others"].select(
        "project", F.col("kind").alias("pipeline"), F.col("schema").alias("plan_pos"), F.lit("").alias("task"),
        F.lit("").alias("depends_on"), F.lit(False).alias("finalizer"),
    ))


def p2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.matrix_rejects(views.tasks(spark, sf_dir))


def e6_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.redact_env(views.tasks(spark, sf_dir)).select(
        "project_id", "base", _text("env_names").alias("env_names"), "env_text"
    )


def p1_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = views.tasks(spark, sf_dir).select(
        "project_id", "base",
        F.explode(F.concat("depends_on", F.array(
            F.concat("base", F.lit("[os=mac,arch=x="), F.col("p") % 5, F.lit("]")),
            F.concat("base", F.lit("[os=mac,os=win]")),
            F.concat("base", F.lit("[]")), F.concat(F.lit("["), "base", F.lit("=1]")),
        ))).alias("ref"),
    )
    return mx.parse_refs(refs.withColumnRenamed("base", "owner")).select(
        "project_id", "owner", "ref", "base", _dims_text(F.col("dims")).alias("dims"), "valid"
    )


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.expand_matrix(views.tasks(spark, sf_dir))


def p2_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir).select(
        "project_id", "base", "task_id", _dims_text(F.col("dims")).alias("dims")
    )


def p3_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.interpolate(_instances(spark, sf_dir)).select(
        "project_id", "task_id",
        F.array_join("command", "|", "?").alias("command"), "cwd",
        F.col("env")["OS"].alias("env_os"),
        F.array_join("inputs", "|", "?").alias("inputs"),
        F.array_join("outputs", "|", "?").alias("outputs"),
        _text(F.array_sort("errors")).alias("errors"),
    )


def p4_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, errors = mx.resolve_edges(_instances(spark, sf_dir), views.tasks(spark, sf_dir))
    return edges.select(
        "project_id", "task_id", F.col("dep_pos").cast("string").alias("dep_pos"), "dep_id",
        F.lit(None).cast("string").alias("error"),
    ).unionByName(errors.select(
        "project_id", "task_id", F.lit(None).cast("string").alias("dep_pos"),
        F.col("ref").alias("dep_id"), "error",
    ))


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    instances = _instances(spark, sf_dir)
    edges, _ = mx.resolve_edges(instances, views.tasks(spark, sf_dir))
    edges = settle(edges, "plan-edges")
    digit = F.col("p_size") % 10
    roots = instances.withColumn("pipeline", F.lit("ci")).dropDuplicates(["project_id", "task_id"])
    members = graph.mark_finalizers(edges, roots.where(digit == 1), roots.where(digit == 2))
    levels = graph.task_levels(edges, instances)
    filled = mx.interpolate(instances.dropDuplicates(["project_id", "task_id"]))
    return planning.build_plan(filled, edges, levels, members), edges


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan(spark, sf_dir)
    return plan.select("project_id", "task_id", "pipeline", "finalizer", "dep_count", "level", "line", "reason")


def p10_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.list_projects(
        views.projects(spark, sf_dir), views.tasks(spark, sf_dir), views.pipelines(spark, sf_dir)
    )


def p14_nearest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, roots = views.paths(spark, sf_dir)
    return planning.nearest_root(paths, roots)


def l1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_fields(
        views.tasks(spark, sf_dir), views.pipelines(spark, sf_dir), views.projects(spark, sf_dir)
    )


def l2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_patterns(views.tasks(spark, sf_dir))


def l3_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_matrix(views.tasks(spark, sf_dir))


def l4_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint_references(
        views.tasks(spark, sf_dir), views.pipelines(spark, sf_dir), views.projects(spark, sf_dir)
    )


def l7_check_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: all problems of all projects."""
    return project_plan.check_projects(
        views.projects(spark, sf_dir), views.tasks(spark, sf_dir), views.pipelines(spark, sf_dir)
    )


def l5_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed, known = views.names(spark, sf_dir)
    return lint.suggest_names(typed, known)


def l6_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), "event_id").alias("project_id"),
        F.concat(
            F.lit('{"schema":1,"'), "event_type", F.lit('":'), "props",
            F.lit(',"project":{"name":"x","k":1},"tasks":{"a":'), "props",
            F.lit(',"b":{"command":[],"retries":1}},"pipelines":{"ci":'), "props", F.lit("}}"),
        ).alias("manifest"),
    )
    return lint.unknown_fields(raw)


QUERIES = {
    f.__name__: f
    for f in [
        s2_manifests, s2_projects, s3_documents, s3_lists, s3_plans, e6_redact, p1_refs, p2_matrix, p2_rejects, p3_interpolate, p4_edges, p9_plan,
        p10_list, p14_nearest_root, l1_fields, l2_patterns, l3_matrix, l4_references, l5_suggest,
        l6_unknown, l7_check_projects,
    ]
}


def _fill(value: str) -> str:
    """SQL for one text with the two known dimensions filled in, null on errors."""
    return (
        f"CASE WHEN contains({value}, '${{os}}') AND os IS NULL THEN NULL "
        f"WHEN contains({value}, '${{size}}') AND size IS NULL THEN NULL "
        f"WHEN contains({value}, '${{oops') THEN NULL "
        f"ELSE replace(replace({value}, '${{os}}', coalesce(os, '')), '${{size}}', coalesce(size, '')) END"
    )


_FILLED = f""", named AS (
  SELECT i.project_id, i.task_id, i.base,
    CASE WHEN k1 = 'os' THEN v1 END AS os, CASE WHEN k2 = 'size' THEN v2 END AS size,
    t.* EXCLUDE (project_id, base)
  FROM v_inst i JOIN v_task t ON t.project_id = i.project_id AND t.base = i.base),
filled AS (
  SELECT project_id, task_id, os, size, timeout_seconds, max_output_bytes, resource_group, retries,
    retry_backoff_seconds, p_size,
    list_transform(command, lambda x: {_fill('x')}) AS command,
    {_fill("coalesce(cwd, '.')")} AS cwd, {_fill('env_os')} AS env_os,
    list_transform(inputs, lambda x: {_fill('x')}) AS inputs,
    list_transform(outputs, lambda x: {_fill('x')}) AS outputs,
    list_concat(command, inputs, outputs, [coalesce(cwd, '.'), env_os]) AS texts
  FROM named)"""

_EDGES = """, refs AS (
  SELECT project_id, base, unnest(range(len(depends_on))) AS ref_pos, unnest(depends_on) AS ref
  FROM v_task),
uses AS (
  SELECT i.project_id, i.task_id, i.k1, i.v1, i.k2, i.v2, ref_pos, ref,
    CASE WHEN contains(ref, '[os=linux]') THEN replace(ref, '[os=linux]', '') ELSE ref END AS target,
    contains(ref, '[os=linux]') AS explicit
  FROM v_inst i JOIN refs r ON r.project_id = i.project_id AND r.base = i.base),
judged AS (
  SELECT u.*, CASE WHEN ref = 'bad[ref' THEN 'invalid reference'
    WHEN t.base IS NULL THEN 'unknown task'
    WHEN explicit AND len(matrix) = 0 THEN 'task has no matrix'
    WHEN explicit AND len(matrix) <> 1 THEN 'not every dimension given'
    WHEN explicit AND (matrix[1].k <> 'os' OR NOT list_contains(matrix[1].vs, 'linux'))
      THEN 'unknown dimension or value'
    WHEN len(matrix) = 2 AND len(matrix[1].vs) * len(matrix[2].vs) > 1024 THEN 'matrix too large'
    END AS error
  FROM uses u LEFT JOIN v_task t ON t.project_id = u.project_id AND t.base = u.target),
matched AS (
  SELECT j.project_id, j.task_id, j.ref_pos, j.ref, d.task_id AS dep_id,
    row_number() OVER (PARTITION BY j.project_id, j.task_id, j.k1, j.o, j.ref_pos
      ORDER BY d.o1, d.o2) - 1 AS i
  FROM (SELECT *, row_number() OVER () AS o FROM judged WHERE error IS NULL AND NOT explicit) j
  JOIN v_inst d ON d.project_id = j.project_id AND d.base = j.target
    AND (j.k1 IS NULL OR d.k1 IS NULL OR j.k1 <> d.k1 OR j.v1 = d.v1)
    AND (j.k2 IS NULL OR d.k2 IS NULL OR j.k2 <> d.k2 OR j.v2 = d.v2)),
edge AS (
  SELECT project_id, task_id, ref_pos * 1024 + i AS dep_pos, dep_id FROM matched
  UNION ALL SELECT project_id, task_id, ref_pos * 1024, ref FROM judged
  WHERE error IS NULL AND explicit)"""

_QUOTED = """array_to_string(list_transform(command, lambda x: CASE
  WHEN regexp_full_match(x, '[A-Za-z0-9_.=/:+-]*') THEN x
  ELSE '''' || replace(x, '''', '''\\''''') || '''' END), ' ')"""

_PLAN = _FILLED + _EDGES + """,
root AS (SELECT DISTINCT project_id, task_id, p_size % 10 AS kind FROM filled WHERE p_size % 10 IN (1, 2)),
normal AS (SELECT project_id, task_id FROM root WHERE kind = 1
  UNION SELECT e.project_id, e.dep_id FROM normal n
    JOIN edge e ON e.project_id = n.project_id AND e.task_id = n.task_id),
late AS (SELECT project_id, task_id FROM root WHERE kind = 2
  UNION SELECT e.project_id, e.dep_id FROM late n
    JOIN edge e ON e.project_id = n.project_id AND e.task_id = n.task_id),
members AS (SELECT *, (project_id, task_id) IN (SELECT (project_id, task_id) FROM root WHERE kind = 2)
    OR (project_id, task_id) NOT IN (SELECT (project_id, task_id) FROM normal) AS finalizer
  FROM (SELECT * FROM normal UNION SELECT * FROM late)),
depth AS (SELECT DISTINCT i.project_id, i.task_id, 0 AS level FROM v_inst i
    WHERE (i.project_id, i.task_id) NOT IN (SELECT (project_id, task_id) FROM edge)
  UNION SELECT e.project_id, e.task_id, d.level + 1 FROM depth d
    JOIN edge e ON e.project_id = d.project_id AND e.dep_id = d.task_id),
lv AS (SELECT project_id, task_id, max(level)::BIGINT AS level FROM depth GROUP BY ALL),
dc AS (SELECT project_id, task_id, count(*) AS dep_count FROM edge GROUP BY ALL)
"""

ORACLE = {
    "s2_manifests": with_views(["v_task", "v_proj"], """
SELECT project_id, base, array_to_string(command, '|') AS command, cwd, stdin, cache,
  timeout_seconds::BIGINT AS timeout_seconds, max_output_bytes::BIGINT AS max_output_bytes,
  retries, len(matrix) AS n_dims, env_level, array_to_string(depends_on, '|') AS depends_on,
  array_to_string(inputs, '|') AS inputs, array_to_string(outputs, '|') AS outputs,
  array_to_string(cache_env, '|') AS cache_env, resource_group,
  retry_backoff_seconds::BIGINT AS retry_backoff_seconds,
  array_to_string(list_transform(matrix, lambda m: m.k || '=' || array_to_string(m.vs, ',')), '|') AS matrix
FROM v_task"""),
    "s2_projects": with_views(["v_lane", "v_proj"], """
SELECT project_id, 'project' AS part, project_name AS name, schema::VARCHAR AS first,
  default_pipeline AS second FROM v_proj
UNION ALL SELECT project_id, 'pipeline', pipeline, array_to_string(tasks, '|'), array_to_string(fins, '|')
FROM v_lane"""),
    "s3_documents": with_views(["v_edge"], """
SELECT n.project_id AS project, n.task_id AS task, (row_number() OVER (
    PARTITION BY n.project_id, n.task_id ORDER BY dep_pos) - 1
    + CASE WHEN dep_id IS NULL THEN NULL ELSE 0 END)::VARCHAR AS dep_pos, dep_id
FROM v_node n LEFT JOIN v_edge e ON e.project_id = n.project_id AND e.task_id = n.task_id"""),
    "s3_lists": with_views(["v_proj", "v_lane"], """
, head AS (SELECT project_name AS project, '/' || project_id AS root, default_pipeline, project_id FROM v_proj)
SELECT project, root, 'task' AS part, base AS name, array_to_string(command, '|') AS first, stdin AS second
FROM head JOIN v_task USING (project_id)
UNION ALL SELECT project, root, 'pipeline', pipeline, array_to_string(tasks, '|'), array_to_string(fins, '|')
FROM head JOIN v_lane USING (project_id)
UNION ALL SELECT project, root, 'project', '', default_pipeline, '' FROM head
UNION ALL SELECT 'bare', '/bare', 'project', '', 'ci', ''"""),
    "s3_plans": with_views(["v_inst"], _PLAN + """,
planned AS (SELECT DISTINCT m.project_id, m.task_id, finalizer, level FROM members m
  JOIN lv ON lv.project_id = m.project_id AND lv.task_id = m.task_id),
lanes AS (SELECT *, 'ci' AS pipeline FROM planned UNION ALL SELECT *, 'even' FROM planned WHERE length(task_id) % 2 = 0),
needs AS (SELECT project_id, task_id, string_agg(dep_id, '|' ORDER BY dep_pos) AS deps FROM edge GROUP BY ALL)
SELECT l.project_id AS project, pipeline, row_number() OVER (PARTITION BY l.project_id, pipeline
    ORDER BY level, l.task_id) - 1 AS plan_pos, l.task_id AS task, coalesce(deps, '') AS depends_on, finalizer
FROM lanes l LEFT JOIN needs n ON n.project_id = l.project_id AND n.task_id = l.task_id
UNION ALL SELECT 'later', 'plan', 9, '', '', false FROM range(3)""", True),
    "e6_redact": with_views(["v_task"], """
SELECT project_id, base, 'LEVEL|OS' AS env_names, 'LEVEL=<redacted> OS=<redacted>' AS env_text
FROM v_task"""),
    "p1_refs": with_views(["v_task"], r"""
SELECT project_id, owner, ref,
  CASE WHEN valid THEN regexp_replace(ref, '\[.*$', '') END AS base,
  CASE WHEN valid AND contains(ref, '[') THEN (SELECT string_agg(x, '|' ORDER BY x) FROM (
    SELECT unnest(string_split(regexp_extract(ref, '\[(.*)\]$', 1), ',')) AS x)) ELSE '' END AS dims,
  valid
FROM (SELECT *, NOT contains(ref, '[') OR
    (regexp_full_match(ref, '[^\[]+\[[^=,]+=[^,]+(,[^=,]+=[^,]+)*\]') AND NOT regexp_full_match(ref, '[^\[]+\[os=mac,os=win\]'))
    AS valid FROM (
  SELECT project_id, base AS owner, unnest(list_concat(depends_on, [
    base || '[os=mac,arch=x=' || (p % 5) || ']', base || '[os=mac,os=win]', base || '[]',
    '[' || base || '=1]'])) AS ref FROM v_task))"""),
    "p2_matrix": with_views(["v_inst"], """
SELECT project_id, base, task_id, CASE WHEN k1 IS NULL THEN '' ELSE k1 || '=' || v1
  || coalesce('|' || k2 || '=' || v2, '') END AS dims FROM v_inst"""),
    "p2_rejects": with_views(["v_task"], """
SELECT project_id, base, (len(matrix[1].vs) * len(matrix[2].vs))::BIGINT AS instances,
  'matrix too large' AS reason FROM v_task
WHERE len(matrix) = 2 AND len(matrix[1].vs) * len(matrix[2].vs) > 1024"""),
    "p3_interpolate": with_views(["v_inst"], _FILLED + """
SELECT project_id, task_id,
  array_to_string(list_transform(command, lambda x: coalesce(x, '?')), '|') AS command, cwd, env_os,
  array_to_string(list_transform(inputs, lambda x: coalesce(x, '?')), '|') AS inputs,
  array_to_string(list_transform(outputs, lambda x: coalesce(x, '?')), '|') AS outputs,
  concat_ws('|',
    CASE WHEN os IS NULL AND len(list_filter(texts, lambda x: contains(x, '${os}'))) > 0
      THEN 'unknown placeholder os' END,
    CASE WHEN size IS NULL AND len(list_filter(texts, lambda x: contains(x, '${size}'))) > 0
      THEN 'unknown placeholder size' END,
    CASE WHEN size IS NOT NULL AND len(list_filter(texts, lambda x: contains(x, '${oops'))) > 0
      THEN 'unterminated placeholder' END) AS errors
FROM filled"""),
    "p4_edges": with_views(["v_inst"], _EDGES + """
SELECT project_id, task_id, (row_number() OVER (PARTITION BY project_id, task_id ORDER BY dep_pos)
  - 1)::VARCHAR AS dep_pos, dep_id, NULL AS error FROM edge
UNION ALL SELECT project_id, task_id, NULL, ref, error FROM judged WHERE error IS NOT NULL
UNION ALL SELECT project_id, task_id, NULL, ref, 'inherited value is missing' FROM judged j
WHERE error IS NULL AND NOT explicit AND NOT EXISTS (SELECT 1 FROM matched m
  WHERE m.project_id = j.project_id AND m.task_id = j.task_id AND m.ref_pos = j.ref_pos)"""),
    "p9_plan": with_views(["v_inst"], _PLAN + f"""
SELECT DISTINCT m.project_id, m.task_id, 'ci' AS pipeline, finalizer, coalesce(dep_count, 0) AS dep_count,
  level, CASE WHEN cwd IS NULL OR list_contains(list_transform(command, lambda x: x IS NULL), true) THEN NULL
  ELSE 'x' END AS ok,
  'would run ' || m.task_id || ' in ' || cwd || ': ' || {_QUOTED} || ' [timeout=' || timeout_seconds
  || 's] [max_output_bytes=' || max_output_bytes || ']'
  || coalesce(' [resource_group=' || resource_group || ']', '')
  || CASE WHEN len(inputs) > 0 THEN ' [inputs=' || array_to_string(inputs, ', ') || ']' ELSE '' END
  || CASE WHEN len(outputs) > 0 THEN ' [outputs=' || array_to_string(outputs, ', ') || ']' ELSE '' END
  || CASE WHEN retries > 0 THEN ' [retries=' || retries || ']' ELSE '' END
  || CASE WHEN retries > 0 AND retry_backoff_seconds > 0
    THEN ' [retry_backoff=' || retry_backoff_seconds || 's]' ELSE '' END
  || CASE WHEN finalizer THEN ' [finally]' ELSE '' END
  || ' [env LEVEL=<redacted>] [env OS=<redacted>]' AS line, NULL::VARCHAR AS reason
FROM members m JOIN filled f ON f.project_id = m.project_id AND f.task_id = m.task_id
JOIN lv ON lv.project_id = m.project_id AND lv.task_id = m.task_id
LEFT JOIN dc ON dc.project_id = m.project_id AND dc.task_id = m.task_id""".replace(
        """ CASE WHEN cwd IS NULL OR list_contains(list_transform(command, lambda x: x IS NULL), true) THEN NULL
  ELSE 'x' END AS ok,
 """, ""), True),
    "p10_list": with_views(["v_lane", "v_proj"], f"""
SELECT project_id, 0 AS section, project_id AS name, 'project ' || project_name AS line FROM v_proj
UNION ALL SELECT project_id, 1, pipeline, '  ' || pipeline || ': ' || array_to_string(tasks, ', ')
  || CASE WHEN len(fins) > 0 THEN chr(10) || '    finally: ' || array_to_string(fins, ', ') ELSE '' END
  FROM v_lane
UNION ALL SELECT project_id, 2, base, '  ' || base || ': ' || {_QUOTED} FROM v_task"""),
    "p14_nearest_root": with_views(["v_path", "v_rootdir"], """
SELECT path, (SELECT arg_max(root, length(root)) FROM v_rootdir
  WHERE path = root OR starts_with(path, root || '/')) AS root FROM v_path"""),
    "l1_fields": with_views(["v_lane", "v_proj"], """
SELECT project_id, project_id AS subject, 'schema' AS rule, schema::VARCHAR AS detail FROM v_proj
  WHERE schema <> 1
UNION ALL SELECT project_id, project_id, 'project name', '' FROM v_proj WHERE project_name = ''
UNION ALL SELECT project_id, pipeline, 'pipeline name', '' FROM v_lane WHERE pipeline = ''
UNION ALL SELECT project_id, pipeline, 'pipeline without tasks', '' FROM v_lane WHERE len(tasks) = 0
UNION ALL SELECT project_id, base, 'task name characters', '' FROM v_task WHERE base SIMILAR TO '.*[][=,].*'
UNION ALL SELECT project_id, base, 'command is empty', '' FROM v_task WHERE coalesce(command[1], '') = ''
UNION ALL SELECT project_id, base, 'cacheable with inherited stdin', '' FROM v_task
  WHERE cache AND stdin = 'inherit'
UNION ALL SELECT project_id, base, 'cache_env name', '' FROM v_task WHERE list_contains(cache_env, 'A=B')
UNION ALL SELECT project_id, base, 'timeout is zero', '' FROM v_task WHERE timeout_seconds = 0
UNION ALL SELECT project_id, base, 'output limit is zero', '' FROM v_task WHERE max_output_bytes = 0
UNION ALL SELECT project_id, base, 'retry backoff', retry_backoff_seconds::VARCHAR FROM v_task
  WHERE retries > 0 AND retry_backoff_seconds > 86400
UNION ALL SELECT project_id, base, 'resource group', resource_group FROM v_task
  WHERE resource_group IN ('', 'a:b')
UNION ALL SELECT project_id, base, 'cwd', cwd FROM v_task WHERE cwd IN ('../out', '/abs')"""),
    "l2_patterns": with_views(["v_task"], """
SELECT project_id, base AS subject, 'no positive input' AS rule, '' AS detail FROM v_task
  WHERE cache AND len(list_filter(inputs, lambda x: NOT starts_with(x, '!'))) = 0
UNION ALL SELECT project_id, base, 'no positive output', '' FROM v_task WHERE outputs = ['!only']
UNION ALL SELECT project_id, base, 'pattern empty or absolute', x FROM (
  SELECT project_id, base, unnest(list_concat(inputs, outputs)) AS x FROM v_task)
  WHERE x = '' OR starts_with(x, '/')
UNION ALL SELECT project_id, base, 'pattern segment', x FROM (
  SELECT project_id, base, unnest(list_concat(inputs, outputs)) AS x FROM v_task)
  WHERE x <> '' AND (contains(x, '//') OR starts_with(x, '/') OR contains(x, '..'))"""),
    "l3_matrix": with_views(["v_dim"], """
SELECT project_id, base AS subject, 'too many instances' AS rule, '1600' AS detail FROM v_task
  WHERE len(matrix) = 2 AND len(matrix[1].vs) * len(matrix[2].vs) > 1024
UNION ALL SELECT project_id, base, 'empty dimension', dim FROM v_dim WHERE len(vals) = 0
UNION ALL SELECT project_id, base, 'dimension value', dim FROM v_dim
  WHERE len(list_filter(vals, lambda v: contains(v, '='))) > 0
UNION ALL SELECT project_id, base, 'duplicate value', dim FROM v_dim
  WHERE len(list_distinct(vals)) < len(vals)"""),
    "l4_references": with_views(["v_lane", "v_proj"], """, refs AS (
  SELECT project_id, base AS subject, unnest(depends_on) AS ref FROM v_task
  UNION ALL SELECT project_id, pipeline, unnest(list_concat(tasks, fins)) FROM v_lane),
j AS (SELECT r.*, t.base, t.matrix, contains(ref, '[os=linux]') AS explicit FROM refs r
  LEFT JOIN v_task t ON t.project_id = r.project_id AND t.base = replace(ref, '[os=linux]', ''))
SELECT project_id, subject, rule, ref AS detail FROM (SELECT *, CASE
    WHEN contains(replace(ref, '[os=linux]', ''), '[') THEN 'invalid reference'
    WHEN base IS NULL THEN 'unknown task'
    WHEN explicit AND len(matrix) = 0 THEN 'task has no matrix'
    WHEN explicit AND len(matrix) <> 1 THEN 'not every dimension given'
    WHEN explicit AND NOT list_contains(matrix[1].vs, 'linux') THEN 'unknown dimension or value'
    WHEN len(matrix) = 2 AND len(matrix[1].vs) * len(matrix[2].vs) > 1024 THEN 'matrix too large'
    WHEN len(matrix) = 1 AND len(matrix[1].vs) = 0 THEN 'inherited value is missing' END AS rule FROM j)
WHERE rule IS NOT NULL
UNION ALL SELECT project_id, project_id, 'unknown default pipeline', default_pipeline FROM v_proj p
  WHERE NOT EXISTS (SELECT 1 FROM v_lane l WHERE l.project_id = p.project_id
    AND l.pipeline = p.default_pipeline)
UNION ALL SELECT f.project_id, f.pipeline, 'cacheable finalizer', f.ref FROM (
  SELECT project_id, pipeline, unnest(fins) AS ref FROM v_lane) f
  JOIN v_task t ON t.project_id = f.project_id AND t.base = f.ref AND t.cache
  AND NOT contains(f.ref, '[')"""),
    "l5_suggest": """
WITH known AS (SELECT DISTINCT p_brand AS project_id, p_name AS candidate FROM part),
typed AS (SELECT DISTINCT p_brand AS project_id, p_name[1] || p_name[3:] AS name FROM part)
SELECT project_id, name, candidate AS suggestion FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY d, candidate) AS r FROM (
    SELECT t.project_id, name, candidate, levenshtein(name, candidate) AS d
    FROM typed t JOIN known k ON k.project_id = t.project_id AND name <> candidate)
  WHERE d <= CASE WHEN strlen(name) <= 4 THEN 1 ELSE 2 END) WHERE r = 1""",
    "l6_unknown": """
WITH e AS (SELECT 'event-' || event_id AS project_id, event_type FROM events)
SELECT project_id, project_id AS subject, 'unknown manifest field' AS rule, event_type AS detail FROM e
UNION ALL SELECT project_id, project_id, 'unknown project field', 'k' FROM e
UNION ALL SELECT project_id, 'a', 'unknown task field', 'k' FROM e
UNION ALL SELECT project_id, 'ci', 'unknown pipeline field', 'k' FROM e""",
}

ORACLE["l7_check_projects"] = " UNION ALL ".join(
    f"SELECT project_id, subject, rule, detail FROM ({ORACLE[name]})"
    for name in ("l1_fields", "l2_patterns", "l3_matrix", "l4_references")
)
