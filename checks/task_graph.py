"""Checks for task-graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import with_views
from runledger.operators import graph


def p5_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, _ = views.pipeline_roots(spark, sf_dir)
    return graph.dependency_closure(views.edges(spark, sf_dir), roots)


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.plan_levels(views.edges(spark, sf_dir), views.graph_nodes(spark, sf_dir))


def p6_levels_beside_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.plan_levels(views.edges(spark, sf_dir, cycles=True),
                             views.graph_nodes(spark, sf_dir))


def p7_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_cycles(views.edges(spark, sf_dir, cycles=True))


def _finalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, late = views.pipeline_roots(spark, sf_dir)
    return graph.mark_finalizers(views.edges(spark, sf_dir), normal, late)


def p8_finalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalizers(spark, sf_dir)


def p11_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_table(views.edges(spark, sf_dir), views.graph_nodes(spark, sf_dir))


def p12_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = views.graph_runs(spark, sf_dir).withColumnRenamed("state", "status")
    return graph.waiting_tasks(states, views.edges(spark, sf_dir), states.where("status <> 'active'"))


def p13_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.graph_runs(spark, sf_dir).withColumnRenamed("state", "status")
    finalizers = _finalizers(spark, sf_dir).where("finalizer")
    return graph.blocked_by(views.edges(spark, sf_dir), results, finalizers)


def p13_first_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.graph_runs(spark, sf_dir).withColumnRenamed("state", "status")
    finalizers = _finalizers(spark, sf_dir).where("finalizer")
    return graph.first_blockers(views.edges(spark, sf_dir), results, finalizers)


def p15_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.serialize_graph(views.edges(spark, sf_dir), views.graph_nodes(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in [
        p5_closure, p6_levels, p6_levels_beside_cycles, p7_cycles, p8_finalizers, p11_degree,
        p12_waiting, p13_blocked, p13_first_blocker, p15_graph,
    ]
}

_MEMBERS = """, normal AS (
  SELECT project_id, pipeline, task_id FROM v_root
  UNION SELECT e.project_id, n.pipeline, e.dep_id FROM normal n
    JOIN v_edge e ON e.project_id = n.project_id AND e.task_id = n.task_id),
late AS (
  SELECT project_id, pipeline, task_id FROM v_fin
  UNION SELECT e.project_id, n.pipeline, e.dep_id FROM late n
    JOIN v_edge e ON e.project_id = n.project_id AND e.task_id = n.task_id),
members AS (
  SELECT project_id, pipeline, task_id, (project_id, task_id) NOT IN
      (SELECT (project_id, task_id) FROM normal)
    OR (project_id, task_id) IN (SELECT (project_id, task_id) FROM v_fin) AS finalizer
  FROM (SELECT * FROM normal UNION SELECT * FROM late))"""

_REACH = """, reach AS (
  SELECT project_id, task_id AS src, dep_id AS dst FROM v_cyc
  UNION SELECT r.project_id, r.src, e.dep_id FROM reach r
    JOIN v_cyc e ON e.project_id = r.project_id AND e.task_id = r.dst),
looped AS (SELECT DISTINCT project_id, src AS task_id FROM reach WHERE src = dst),
residue AS (SELECT project_id, task_id FROM looped
  UNION SELECT r.project_id, r.src FROM reach r JOIN looped l
    ON l.project_id = r.project_id AND l.task_id = r.dst)"""

_WALK = """,
walk AS (
  SELECT run_id, project_id, task_id AS failed_task, task_id, 0 AS hops FROM v_grun
  WHERE state IN ('failed', 'timed_out', 'cancelled')
  UNION SELECT w.run_id, w.project_id, w.failed_task, e.task_id, w.hops + 1 FROM walk w
    JOIN v_edge e ON e.project_id = w.project_id AND e.dep_id = w.task_id
    WHERE (e.project_id, e.task_id) NOT IN
      (SELECT (project_id, task_id) FROM members WHERE finalizer))
"""

ORACLE = {
    "p5_closure": with_views(["v_edge", "v_root"], """, walk AS (
  SELECT project_id, task_id AS root, task_id, 0 AS hops FROM v_root
  UNION SELECT e.project_id, w.root, e.dep_id, w.hops + 1 FROM walk w
    JOIN v_edge e ON e.project_id = w.project_id AND e.task_id = w.task_id)
SELECT project_id, root, task_id, min(hops)::BIGINT AS hops FROM walk GROUP BY ALL""", True),
    "p6_levels": with_views(["v_edge"], """, walk AS (
  SELECT project_id, task_id, 0 AS level FROM v_node n
    WHERE NOT EXISTS (SELECT 1 FROM v_edge e WHERE e.project_id = n.project_id AND e.task_id = n.task_id)
  UNION SELECT e.project_id, e.task_id, w.level + 1 FROM walk w
    JOIN v_edge e ON e.project_id = w.project_id AND e.dep_id = w.task_id),
top AS (SELECT project_id, task_id, max(level)::BIGINT AS level FROM walk GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY level, task_id) - 1 AS plan_order
FROM top""", True),
    "p6_levels_beside_cycles": with_views(["v_cyc"], _REACH + """, walk AS (
  SELECT project_id, task_id, 0 AS level FROM v_node n
    WHERE NOT EXISTS (SELECT 1 FROM v_cyc e WHERE e.project_id = n.project_id AND e.task_id = n.task_id)
  UNION SELECT e.project_id, e.task_id, w.level + 1 FROM walk w
    JOIN v_cyc e ON e.project_id = w.project_id AND e.dep_id = w.task_id
    WHERE (e.project_id, e.task_id) NOT IN (SELECT (project_id, task_id) FROM residue)),
top AS (SELECT project_id, task_id, max(level)::BIGINT AS level FROM walk GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY level, task_id) - 1 AS plan_order
FROM top""", True),
    "p7_cycles": with_views(["v_cyc"], _REACH + """, mutual AS (
  SELECT a.project_id, a.src AS task_id, min(a.dst) AS part FROM reach a
    JOIN reach b ON b.project_id = a.project_id AND b.src = a.dst AND b.dst = a.src GROUP BY ALL),
inner_link AS (SELECT DISTINCT e.project_id, e.task_id, e.dep_id FROM v_cyc e
  JOIN mutual m ON m.project_id = e.project_id AND m.task_id = e.task_id
  JOIN mutual n ON n.project_id = e.project_id AND n.task_id = e.dep_id AND n.part = m.part),
trail AS (
  SELECT project_id, task_id, dep_id AS here, [dep_id] AS path FROM inner_link
  UNION ALL SELECT t.project_id, t.task_id, e.dep_id, list_append(t.path, e.dep_id) FROM trail t
    JOIN inner_link e ON e.project_id = t.project_id AND e.task_id = t.here
    WHERE t.here <> t.task_id AND NOT list_contains(t.path, e.dep_id)),
shortest AS (SELECT project_id, task_id, path, list_position(path, list_min(path)) AS k FROM trail
  WHERE here = task_id
  QUALIFY row_number() OVER (PARTITION BY project_id, task_id ORDER BY len(path), path) = 1),
told AS (SELECT project_id, min(task_id) AS cycle_id, arg_min(path, task_id) AS path FROM shortest
  GROUP BY project_id, path[k:] || path[1:k - 1])
SELECT project_id, cycle_id, 0::BIGINT AS pos, cycle_id AS task_id FROM told
UNION ALL SELECT project_id, cycle_id, unnest(range(1, len(path) + 1)), unnest(path) FROM told""", True),
    "p8_finalizers": with_views(["v_edge", "v_root", "v_fin"], _MEMBERS + """
SELECT * FROM members""", True),
    "p11_degree": with_views(["v_edge"], """
SELECT n.project_id, n.task_id, coalesce(d, 0) AS open_deps, coalesce(u, 0) AS dependents,
  coalesce(d, 0) = 0 AS ready FROM v_node n
LEFT JOIN (SELECT project_id, task_id, count(*) AS d FROM v_edge GROUP BY ALL) USING (project_id, task_id)
LEFT JOIN (SELECT project_id, dep_id AS task_id, count(*) AS u FROM v_edge GROUP BY ALL)
  USING (project_id, task_id)"""),
    "p12_waiting": with_views(["v_edge", "v_grun"], """
SELECT r.run_id, r.task_id, count(e.dep_id) AS n_open, min(e.dep_id) AS first_open
FROM v_grun r LEFT JOIN (SELECT DISTINCT g.run_id, e.project_id, e.task_id, e.dep_id FROM v_edge e
    JOIN (SELECT DISTINCT run_id, project_id FROM v_grun) g USING (project_id)
    LEFT JOIN v_grun d ON d.run_id = g.run_id AND d.task_id = e.dep_id AND d.state IN ('completed', 'cached')
    WHERE d.task_id IS NULL) e
  ON e.run_id = r.run_id AND e.project_id = r.project_id AND e.task_id = r.task_id
WHERE r.state IS NULL OR r.state = 'active' GROUP BY r.run_id, r.project_id, r.task_id"""),
    "p13_blocked": with_views(["v_edge", "v_root", "v_fin", "v_grun"], _MEMBERS + _WALK + """
SELECT run_id, failed_task, task_id AS blocked_task, min(hops)::BIGINT AS hops FROM walk
WHERE hops > 0 GROUP BY ALL""", True),
    "p13_first_blocker": with_views(["v_edge", "v_root", "v_fin", "v_grun"], _MEMBERS + _WALK + """
SELECT run_id, min(failed_task) AS failed_task, task_id AS blocked_task FROM walk
WHERE hops > 0 GROUP BY run_id, project_id, task_id""", True),
    "p15_graph": with_views(["v_edge"], """
SELECT n.project_id, n.task_id,
  n.task_id || coalesce(' <- ' || d, '') AS line,
  '{"task":"' || n.task_id || '","depends_on":[' || coalesce('"' || replace(d, ', ', '","') || '"', '')
    || ']}' AS document
FROM v_node n LEFT JOIN (SELECT project_id, task_id, string_agg(dep_id, ', ' ORDER BY dep_pos) AS d
  FROM v_edge GROUP BY ALL) USING (project_id, task_id)"""),
}
