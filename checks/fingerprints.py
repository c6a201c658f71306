"""Checks for fingerprint operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import with_views
from runledger.operators import fingerprint as fp
from runledger.operators import graph


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.select_files(views.files(spark, sf_dir), views.file_tasks(spark, sf_dir))


def f1_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("project_id", "task_id", "path")


def f2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.unmatched_patterns(views.files(spark, sf_dir), views.file_tasks(spark, sf_dir))


def f3_symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.symlink_matches(views.files(spark, sf_dir), views.file_tasks(spark, sf_dir))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.exclude_outputs(_selected(spark, sf_dir), views.file_tasks(spark, sf_dir))


def f4_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir).select("project_id", "task_id", "path")


def f5_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = views.tasks(spark, sf_dir).withColumnRenamed("base", "task_id")
    return fp.select_environment(tasks, views.projects(spark, sf_dir))


def f6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.input_digest(_inputs(spark, sf_dir))


def f7_cacheable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.graph_nodes(spark, sf_dir).withColumn("cache", F.col("p") % 97 != 60)
    return fp.cacheable_tasks(nodes, views.edges(spark, sf_dir)).select(
        "project_id", "task_id", "cache", "cacheable"
    )


def f8_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.graph_nodes(spark, sf_dir).select(
        "project_id", "task_id", F.sha2(F.concat(F.lit("own-"), "p"), 256).alias("own")
    )
    edges = views.edges(spark, sf_dir)
    levels = graph.task_levels(edges, own)
    return fp.task_keys(own, edges, levels)


def f8_own_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _inputs(spark, sf_dir)
    tasks = views.file_tasks(spark, sf_dir).select(
        "*",
        F.array(F.lit("check"), F.col("task_id")).alias("command"),
        F.lit("src").alias("cwd"),
        F.create_map(F.lit("HOME"), F.lit("/root")).alias("env"),
        F.lit(600).alias("timeout_seconds"),
        F.lit(1024).alias("max_output_bytes"),
        F.lit(1).alias("retries"),
        F.lit(0).alias("retry_backoff_seconds"),
        F.lit(None).cast("string").alias("resource_group"),
    )
    projects = tasks.select("project_id").distinct().select(
        "project_id",
        F.lit("linux/x86_64").alias("platform"),
        F.sha2("project_id", 256).alias("manifest_sha256"),
        F.create_map(F.lit("HOME"), F.lit("/home")).alias("environment"),
    )
    environment = fp.select_environment(tasks, projects)
    return fp.own_fingerprint(tasks, fp.input_digest(inputs), environment, projects)


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys, index and stored outputs: a document is a task with two outputs."""
    doc = F.col("doc_id")
    files = views.files(spark, sf_dir)
    key = F.sha2(F.concat(F.lit("key-"), doc), 256)
    keys = files.select("project_id", F.concat(F.lit("task-"), doc).alias("task_id"), key.alias("key"))
    output = lambda name, digest: F.struct(F.lit(name).alias("path"), digest.alias("sha256"))
    index = files.where(doc % 5 != 0).select(
        key.alias("key"),
        F.when(doc % 7 == 0, 2).otherwise(3).cast("bigint").alias("version"),
        F.when(doc % 11 == 0, F.lit("other")).otherwise(key).alias("recorded_key"),
        (doc % 13 != 0).alias("has_stdout"),
        (doc % 17 != 0).alias("has_stderr"),
        F.when(doc % 3 == 0, F.array().cast("array<struct<path:string,sha256:string>>"))
        .otherwise(F.array(output("a", F.col("sha256")), output("b", F.sha2("sha256", 256))))
        .alias("outputs"),
    )
    stored = files.where(doc % 19 != 0).select(
        key.alias("key"), F.lit("a").alias("path"), "sha256"
    ).unionByName(files.select(
        key.alias("key"), F.lit("b").alias("path"),
        F.when(doc % 23 == 0, F.lit("bad")).otherwise(F.sha2("sha256", 256)).alias("sha256"),
    ))
    return keys, index, stored


def f9_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.cache_decisions(*_cache(spark, sf_dir))


def f10_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index, _ = _cache(spark, sf_dir)
    new = views.files(spark, sf_dir).select(
        F.sha2(F.concat(F.lit("key-"), F.floor(F.col("doc_id") / 2)), 256).alias("key"),
        (F.col("doc_id") % 4).alias("written_at"),
        F.concat(F.lit("host-"), F.col("doc_id") % 3).alias("writer"),
        "path",
    )
    return fp.append_entries(index, new)


def f11_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    outputs = views.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(page % 6 == 0, "").when(page % 6 == 1, F.concat(F.lit("/"), "url"))
        .when(page % 6 == 2, F.concat(F.lit("out/../"), page))
        .when(page % 6 == 3, F.concat(F.lit("out/..x/"), page)).otherwise(F.col("url"))
        .alias("path"),
    )
    return fp.unsafe_paths(outputs)


QUERIES = {
    f.__name__: f
    for f in [
        f1_select, f2_unmatched, f3_symlinks, f4_inputs, f5_environment, f6_digest, f7_cacheable,
        f8_keys, f8_own_fingerprint, f9_decisions, f10_append, f11_unsafe,
    ]
}

_FRAME = "strlen({0}) || ':' || {0}"
_DIGEST = f""", item AS (
  SELECT project_id, task_id, path, substr(sha256(path), 1, 3) AS block,
    {_FRAME.format('path')} || {_FRAME.format('size::VARCHAR')} || {_FRAME.format('mode::VARCHAR')}
    || {_FRAME.format('sha256')} AS item
  FROM v_sel WHERE NOT is_symlink AND NOT regexp_matches(path, '^lang/(.*/)?[^/]*9\\.txt$')),
digest AS (
  SELECT project_id, task_id, sha256(string_agg(d, '' ORDER BY block)) AS digest FROM (
    SELECT project_id, task_id, block, sha256(string_agg(item, '' ORDER BY path)) AS d FROM item
    GROUP BY ALL) GROUP BY ALL)"""


def _framed_values(*values: str) -> str:
    return " || ".join(_FRAME.format(f"({v})") for v in values)


_HOME_ENV = "sha256(sha256('4:HOME5:/root'))"

ORACLE = {
    "f1_select": with_views(["v_sel"], """
SELECT project_id, task_id, path FROM v_sel WHERE NOT is_symlink"""),
    "f2_unmatched": with_views(["v_match"], """
SELECT project_id, task_id, idx, source AS pattern FROM v_fpat p WHERE NOT exclude
  AND NOT EXISTS (SELECT 1 FROM v_match m WHERE m.project_id = p.project_id AND m.task_id = p.task_id
    AND m.idx = p.idx AND NOT is_symlink)"""),
    "f3_symlinks": with_views(["v_sel"], """
SELECT project_id, task_id, min(path) AS path FROM v_sel WHERE is_symlink GROUP BY ALL"""),
    "f4_inputs": with_views(["v_sel"], """
SELECT project_id, task_id, path FROM v_sel WHERE NOT is_symlink AND NOT ends_with(path, '9.txt')"""),
    "f5_environment": with_views(["v_task", "v_proj"], """, base AS (
  SELECT t.project_id, base AS task_id, cache_env, env_level, env_os, '/home/' || (t.p - t.p % 512) AS home
  FROM v_task t)
SELECT project_id, task_id, u.variable, u.value FROM (
  SELECT project_id, task_id, unnest(CASE
    WHEN cache_env = ['*'] THEN [{'variable': 'HOME', 'value': home},
      {'variable': 'PATH', 'value': '/bin'}, {'variable': 'LEVEL', 'value': env_level},
      {'variable': 'OS', 'value': env_os}]
    WHEN len(cache_env) = 4 THEN [{'variable': 'HOME', 'value': home},
      {'variable': 'CI', 'value': '<unset>'}, {'variable': 'LEVEL', 'value': env_level}]
    WHEN cache_env = ['A=B'] THEN [{'variable': 'A=B', 'value': '<unset>'}] END) AS u FROM base)"""),
    "f6_digest": with_views(["v_sel"], _DIGEST + "\nSELECT * FROM digest"),
    "f7_cacheable": with_views(["v_edge"], """, taint AS (
  SELECT project_id, task_id FROM v_node WHERE p % 97 = 60
  UNION SELECT e.project_id, e.task_id FROM taint t
    JOIN v_edge e ON e.project_id = t.project_id AND e.dep_id = t.task_id)
SELECT project_id, task_id, p % 97 <> 60 AS cache,
  (project_id, task_id) NOT IN (SELECT (project_id, task_id) FROM taint) AS cacheable
FROM v_node""", True),
    "f8_keys": with_views(["v_node"], """, keys AS (
  SELECT project_id, q, p, sha256(sha256('own-' || p)) AS key, 0 AS step FROM v_node WHERE q = 0
  UNION ALL
  SELECT n.project_id, n.q, n.p, sha256(sha256('own-' || n.p) || sha256(sha256(
      max(k.key) FILTER (k.q = n.q // 2)
      || CASE WHEN n.q // 2 <> n.q // 3 THEN max(k.key) FILTER (k.q = n.q // 3) ELSE '' END))),
    max(k.last) + 1
  FROM (SELECT project_id, q, key, max(step) OVER () AS last FROM recurring.keys) k
  JOIN v_node n ON n.project_id = k.project_id AND k.q IN (n.q // 2, n.q // 3)
    AND n.q >= 1 AND n.q BETWEEN (1 << k.last) AND (2 << k.last) - 1
  GROUP BY n.project_id, n.q, n.p)
SELECT project_id, 't' || q AS task_id, key FROM keys""", True),
    "f8_own_fingerprint": with_views(["v_sel"], _DIGEST + f"""
SELECT project_id, task_id, sha256({_framed_values(
    "'task-key'", "'3'", "'linux/x86_64'", "task_id", "'src'",
    "'2#5:check' || strlen(task_id) || ':' || task_id", "'600'", "'1024'", "'1'", "'0'", "''",
    "pats", "'1#14:lang/**/*9.txt'", "'1#4:HOME'", "sha256(project_id)", _HOME_ENV,
    "coalesce(digest, '')")}) AS own
FROM (SELECT project_id, task_id, count(*) || '#' || string_agg(
    strlen(src) || ':' || src, '' ORDER BY idx) AS pats FROM (
    SELECT *, CASE idx WHEN 1 THEN '!lang/' || task_id[7:] || '/*1.txt' ELSE source END AS src
    FROM v_fpat) GROUP BY ALL)
LEFT JOIN digest USING (project_id, task_id)"""),
    "f9_decisions": with_views(["v_file"], """
SELECT project_id, 'task-' || doc_id AS task_id, sha256('key-' || doc_id) AS key, reason,
  CASE reason WHEN 'ok' THEN 'hit' ELSE 'miss' END AS decision
FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'no entry' WHEN doc_id % 7 = 0 THEN 'other version'
  WHEN doc_id % 11 = 0 THEN 'other key'
  WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'output stream missing'
  WHEN doc_id % 3 = 0 THEN 'ok' WHEN doc_id % 19 = 0 THEN 'output missing'
  WHEN doc_id % 23 = 0 THEN 'output changed' ELSE 'ok' END AS reason FROM v_file)"""),
    "f10_append": with_views(["v_file"], """
SELECT key, written_at, writer, path FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY written_at, writer, path) AS r FROM (
    SELECT sha256('key-' || (doc_id // 2)) AS key, doc_id % 4 AS written_at,
      'host-' || (doc_id % 3) AS writer, path FROM v_file))
WHERE r = 1 AND key NOT IN (SELECT sha256('key-' || doc_id) FROM v_file WHERE doc_id % 5 <> 0)"""),
    "f11_unsafe": """
SELECT page_id, path, CASE WHEN path = '' THEN 'empty' WHEN path[1] = '/' THEN 'absolute'
  ELSE 'parent step' END AS reason
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/' || url
  WHEN 2 THEN 'out/../' || page_id WHEN 3 THEN 'out/..x/' || page_id ELSE url END AS path FROM pages)
WHERE path = '' OR path[1] = '/' OR contains(path, '/../')""",
}
