"""Build-and-release shaped views over the test tables.

The test tables are TPC-H-like. Each view projects one of them, deterministically
and whole, onto the shape an operator expects; ``SQL`` holds the same
definitions for the SQL side of the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _big(value: Column) -> Column:
    return value.cast("bigint")


def status_of(number: Column) -> Column:
    return (
        F.when(number == 0, "failed")
        .when(number == 1, "cached")
        .when(number == 2, "timed_out")
        .when(number == 3, "cancelled")
        .when(number == 4, "blocked")
        .when(number == 5, "output_limit")
        .otherwise("completed")
    )


_STATUS_SQL = """CASE {n} WHEN 0 THEN 'failed' WHEN 1 THEN 'cached' WHEN 2 THEN 'timed_out'
 WHEN 3 THEN 'cancelled' WHEN 4 THEN 'blocked' WHEN 5 THEN 'output_limit' ELSE 'completed' END"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task results: one lineitem is one task of the run of its order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        _big(F.col("l_linenumber")).alias("plan_pos"),
        F.concat(F.lit("task-"), "l_partkey").alias("task"),
        status_of(_big(F.floor("l_quantity")) % 7).alias("status"),
        _big(F.floor("l_extendedprice")).alias("elapsed_ms"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log events: a user is a run, the place of an event its sequence."""
    k = _big(F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("run_id"), kind, "value", k.alias("k"), "ts", "props"
    )
    placed = ordered.position(
        raw, ["run_id"], ["event_id"], ordered.block_of("event_id"), "sequence"
    )
    k = F.col("k")
    started = (kind == "signup") & (k % 2 == 0)
    finished = (kind == "signup") & (k % 2 == 1)
    event = (
        F.when(started, "run_started")
        .when(finished, "run_finished")
        .when(kind == "click", "task_started")
        .when(kind == "error", "task_attempt_started")
        .when(kind == "view", "task_output")
        .when(kind == "purchase", "task_finished")
    )
    is_task = kind != "signup"
    stream = (
        F.when(k % 50 == 49, "stdin").when(k % 2 == 0, "stdout").otherwise("stderr")
    )
    status = F.when(k % 50 == 48, "exploded").otherwise(status_of(k % 7))
    small = [F.col("event_id") % 256, k % 256, F.lit(10)]
    return placed.select(
        "run_id",
        "sequence",
        event.alias("event"),
        F.when(k == 13, 2).otherwise(1).cast("bigint").alias("schema"),
        F.when(started, F.concat(F.lit("proj-"), k)).alias("project"),
        F.when(started, k).alias("task_count"),
        F.when(is_task, F.concat(F.lit("task-"), k % 20)).alias("task"),
        F.when(kind == "view", stream).alias("stream"),
        F.when(kind == "view", F.array(*[b.cast("smallint") for b in small])).alias("bytes"),
        F.when(kind == "error", 1 + k % 3).alias("attempt"),
        F.when(kind == "error", F.lit(3).cast("bigint")).alias("max_attempts"),
        F.when(kind == "purchase", status).alias("status"),
        F.when(kind == "purchase", _big(F.floor("value"))).alias("elapsed_ms"),
        *[
            F.when(finished, _big(k % divisor)).alias(name)
            for name, divisor in _FINISH_DIVISORS
        ],
        F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("bigint").alias("code"),
        F.lit(None).cast("string").alias("message"),
        "ts",
        "props",
    )


_FINISH_DIVISORS = [("completed", 5), ("cached", 3), ("failed", 4), ("cancelled", 2), ("blocked", 6)]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output chunks: a conversation is a run, its turns are chunks of two tasks."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        (F.col("turn") * 2 + 1).alias("sequence"),
        F.concat(F.lit("task-"), F.col("turn") % 2).alias("task"),
        F.when(F.col("role") == "system", "stderr").otherwise("stdout").alias("stream"),
        F.encode("text", "UTF-8").alias("data"),
    )


def chunk_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries that flush unfinished lines: one before every third turn."""
    return table(spark, sf_dir, "conversations").where(F.col("turn") % 3 == 2).select(
        F.col("conv_id").alias("run_id"),
        F.concat(F.lit("task-"), F.col("turn") % 2).alias("task"),
        (F.col("turn") * 2).alias("sequence"),
    )


SQL: dict[str, str] = {
    "v_res": f"""
  SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS plan_pos, 'task-' || l_partkey AS task,
    {_STATUS_SQL.format(n='floor(l_quantity)::BIGINT % 7')} AS status,
    floor(l_extendedprice)::BIGINT AS elapsed_ms
  FROM lineitem""",
    "v_evt0": """
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS sequence FROM (
    SELECT event_id, user_id AS run_id, event_type, value, props, ts,
      json_extract_string(props, '$.k')::BIGINT AS k
    FROM events)""",
    "v_evt": f"""
  SELECT run_id, sequence,
    CASE event_type WHEN 'signup' THEN CASE k % 2 WHEN 0 THEN 'run_started' ELSE 'run_finished' END
      WHEN 'click' THEN 'task_started' WHEN 'error' THEN 'task_attempt_started'
      WHEN 'view' THEN 'task_output' WHEN 'purchase' THEN 'task_finished' END AS event,
    CASE WHEN k = 13 THEN 2 ELSE 1 END AS schema,
    CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN 'proj-' || k END AS project,
    CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN k END AS task_count,
    CASE WHEN event_type <> 'signup' THEN 'task-' || (k % 20) END AS task,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 50 = 49 THEN 'stdin'
      WHEN k % 2 = 0 THEN 'stdout' ELSE 'stderr' END END AS stream,
    CASE WHEN event_type = 'view' THEN [event_id % 256, k % 256, 10] END AS bytes,
    CASE WHEN event_type = 'error' THEN 1 + k % 3 END AS attempt,
    CASE WHEN event_type = 'error' THEN 3 END AS max_attempts,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 50 = 48 THEN 'exploded' ELSE
      {_STATUS_SQL.format(n='k % 7')} END END AS status,
    CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS elapsed_ms,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 5 END AS completed,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 3 END AS cached,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 4 END AS failed,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 2 END AS cancelled,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN k % 6 END AS blocked,
    ts, props
  FROM v_evt0""",
    "v_chunk": """
  SELECT conv_id AS run_id, turn * 2 + 1 AS sequence, 'task-' || (turn % 2) AS task,
    CASE role WHEN 'system' THEN 'stderr' ELSE 'stdout' END AS stream, text
  FROM conversations""",
    "v_break": """
  SELECT conv_id AS run_id, 'task-' || (turn % 2) AS task, turn * 2 AS sequence
  FROM conversations WHERE turn % 3 = 2""",
}

# Views that are built on other views.
_NEEDS = {"v_evt": ["v_evt0"]}


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """Prefix a statement with the definitions of the views it uses."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in wanted)
    if body.lstrip().upper().startswith(","):
        return f"{head}{ctes}{body}"
    return f"{head}{ctes}\n{body}"


PROJECT_TASKS = 512


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("p"),
        F.concat(F.lit("proj-"), F.floor(p / PROJECT_TASKS).cast("bigint")).alias("project_id"),
        (p % PROJECT_TASKS).alias("q"),
        "p_size",
        "p_type",
        "p_brand",
        "p_name",
    )


def _node(number: Column) -> Column:
    return F.concat(F.lit("t"), number.cast("bigint"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per part; 512 parts make a project."""
    return _part(spark, sf_dir).select(
        "project_id", _node(F.col("q")).alias("task_id"), (F.col("p") % 5 != 0).alias("cache"),
        "p", "q", "p_size",
        F.when(F.col("q") % 9 == 0, F.concat(F.lit("g"), F.col("q") % 4)).alias("resource_group"),
    )


def edges(spark: SparkSession, sf_dir: str, cycles: bool = False) -> DataFrame:
    """A task needs its half and its third; ``cycles`` adds back edges."""
    q = F.col("q")
    half, third = F.floor(q / 2), F.floor(q / 3)
    part = _part(spark, sf_dir)

    def edge(rows: DataFrame, task: Column, pos: int, dep: Column) -> DataFrame:
        return rows.select(
            "project_id", _node(task).alias("task_id"),
            F.lit(pos).cast("bigint").alias("dep_pos"), _node(dep).alias("dep_id"),
        )

    out = edge(part.where(q >= 1), q, 0, half).unionByName(
        edge(part.where((q >= 1) & (half != third)), q, 1, third)
    )
    if cycles:
        out = out.unionByName(edge(part.where(q % 50 == 49), half, 2, q)).unionByName(
            edge(part.where(q % 64 == 63), F.floor(q / 8), 3, q)
        )
    return out


def pipeline_roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = graph_nodes(spark, sf_dir).withColumn("pipeline", F.lit("ci"))
    digit = F.col("p_size") % 10
    columns = ["project_id", "pipeline", "task_id"]
    return (
        nodes.where(digit == 1).select(*columns),
        nodes.where((digit == 2) | ((digit == 1) & (F.col("p") % 3 == 0))).select(*columns),
    )


def graph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the projects: status of a task in a run, null if it never ran."""
    n = F.sum(F.floor("l_quantity").cast("bigint"))
    state = F.col("n") % 12
    p = F.col("l_partkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_linenumber")
        .agg(n.alias("n"))
        .select(
            (F.floor(p / PROJECT_TASKS).cast("bigint") * 8 + F.col("l_linenumber")).alias("run_id"),
            F.concat(F.lit("proj-"), F.floor(p / PROJECT_TASKS).cast("bigint")).alias("project_id"),
            _node(p % PROJECT_TASKS).alias("task_id"),
            F.when(state == 0, "failed").when(state == 1, "timed_out").when(state == 2, "cancelled")
            .when(state == 3, None).when(state == 4, "active").when(state == 5, "cached")
            .otherwise("completed").alias("state"),
        )
    )


_P = f"p_partkey // {PROJECT_TASKS}"
_Q = f"p_partkey % {PROJECT_TASKS}"
SQL["v_node"] = f"""
  SELECT 'proj-' || ({_P}) AS project_id, 't' || ({_Q}) AS task_id, p_partkey % 5 <> 0 AS cache,
    p_partkey AS p, {_Q} AS q, p_size,
    CASE WHEN ({_Q}) % 9 = 0 THEN 'g' || (({_Q}) % 4) END AS resource_group FROM part"""
SQL["v_edge"] = """
  SELECT project_id, task_id, 0 AS dep_pos, 't' || (q // 2) AS dep_id FROM v_node WHERE q >= 1
  UNION ALL SELECT project_id, task_id, 1, 't' || (q // 3) FROM v_node
  WHERE q >= 1 AND q // 2 <> q // 3"""
SQL["v_cyc"] = """
  SELECT * FROM v_edge
  UNION ALL SELECT project_id, 't' || (q // 2), 2, task_id FROM v_node WHERE q % 50 = 49
  UNION ALL SELECT project_id, 't' || (q // 8), 3, task_id FROM v_node WHERE q % 64 = 63"""
SQL["v_root"] = """
  SELECT project_id, 'ci' AS pipeline, task_id FROM v_node WHERE p_size % 10 = 1"""
SQL["v_fin"] = """
  SELECT project_id, 'ci' AS pipeline, task_id FROM v_node
  WHERE p_size % 10 = 2 OR (p_size % 10 = 1 AND p % 3 = 0)"""
SQL["v_grun"] = f"""
  SELECT (l_partkey // {PROJECT_TASKS}) * 8 + l_linenumber AS run_id,
    'proj-' || (l_partkey // {PROJECT_TASKS}) AS project_id,
    't' || (l_partkey % {PROJECT_TASKS}) AS task_id,
    CASE sum(floor(l_quantity)::BIGINT) % 12 WHEN 0 THEN 'failed' WHEN 1 THEN 'timed_out'
      WHEN 2 THEN 'cancelled' WHEN 3 THEN NULL WHEN 4 THEN 'active' WHEN 5 THEN 'cached'
      ELSE 'completed' END AS state
  FROM lineitem GROUP BY l_partkey, l_linenumber"""
_NEEDS.update({"v_edge": ["v_node"], "v_cyc": ["v_edge"], "v_root": ["v_node"], "v_fin": ["v_node"]})


def _list(*items: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in items]))


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _matrix(p: Column) -> Column:
    number = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: n.cast("string"))
    linux_mac = _strings("linux", "mac")
    empty = F.map_from_arrays(_strings(), F.array().cast("array<array<string>>"))
    return (
        F.when(p % 47 == 0, F.create_map(F.lit("os"), _strings()))
        .when(p % 53 == 0, F.create_map(F.lit("os"), _strings("a", "a")))
        .when(p % 59 == 0, F.create_map(F.lit("os"), _strings("a=b", "c")))
        .when(p % 61 == 0, F.create_map(F.lit("b"), number, F.lit("a"), number))
        .when(p % 4 == 0, empty)
        .when(p % 4 == 1, F.create_map(F.lit("os"), linux_mac))
        .when(
            p % 4 == 2,
            F.create_map(F.lit("size"), _strings("s", "m", "l"), F.lit("os"), linux_mac),
        )
        .otherwise(F.create_map(F.lit("os"), _strings("linux", "win")))
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest tasks: one per part, so that every lint rule has both kinds."""
    p, q = F.col("p"), F.col("q")
    start = p - q
    name = lambda n: F.concat(F.lit("task-"), n.cast("bigint"))
    yes = F.lit(True)
    return _part(spark, sf_dir).select(
        "p",
        "p_size",
        "project_id",
        F.when(p % 67 == 0, F.concat(F.lit("task-[x"), p))
        .when(p % 71 == 0, F.concat(F.lit("ta=sk-"), p))
        .otherwise(name(p))
        .alias("base"),
        F.when(p % 37 == 0, _strings())
        .when(p % 41 == 0, _strings(""))
        .otherwise(
            F.array(F.lit("build"), F.concat(F.lit("pkg "), p), F.lit("--os=${os}"), F.lit("it's"))
        )
        .alias("command"),
        _list(
            (q >= 1, name(start + F.floor(q / 2))),
            (q % 6 == 5, F.concat(name(start + F.floor(q / 3)), F.lit("[os=linux]"))),
            (q % 31 == 7, F.concat(F.lit("nosuch-"), q)),
            (q % 29 == 3, F.lit("bad[ref")),
        ).alias("depends_on"),
        F.when(p % 7 == 0, "../out").when(p % 7 == 1, "src/${os}").when(p % 7 == 2, "/abs")
        .alias("cwd"),
        F.create_map(
            F.lit("LEVEL"), F.concat(F.lit("l"), p % 3), F.lit("OS"),
            F.when(p % 10 == 3, "${size}-${oops").otherwise("${os}"),
        ).alias("env"),
        F.when(p % 5 == 0, "inherit").otherwise("null").alias("stdin"),
        (p % 5 != 1).alias("cache"),
        F.when(p % 11 == 0, _strings())
        .when(p % 11 == 1, _strings("!a/**"))
        .when(p % 11 == 2, _strings("/abs/x", "ok/*"))
        .when(p % 11 == 3, _strings("a//b"))
        .when(p % 11 == 4, _strings("a/../b"))
        .otherwise(
            F.array(F.concat(F.lit("src/"), "p_type", F.lit("/**")), F.lit("!src/tmp/**"),
                    F.lit("conf/${os}.toml"))
        )
        .alias("inputs"),
        F.when(p % 13 == 0, _strings("!only"))
        .when(p % 13 == 1, _strings(""))
        .when(p % 13 == 2, _strings("dist/${os}/app", "dist/**"))
        .otherwise(_strings())
        .alias("outputs"),
        F.when(p % 17 == 0, _strings("A=B"))
        .when(p % 17 == 1, _strings("*"))
        .when(p % 17 == 2, _strings("HOME", "CI", "HOME", "LEVEL"))
        .otherwise(_strings())
        .alias("cache_env"),
        _list((yes, F.when(p % 19 == 0, 0).otherwise(600)))[0].cast("bigint")
        .alias("timeout_seconds"),
        F.when(p % 23 == 0, 0).otherwise(16777216).cast("bigint").alias("max_output_bytes"),
        F.when(p % 31 == 0, "").when(p % 31 == 1, "a:b").when(p % 31 == 2, "db")
        .alias("resource_group"),
        (p % 3).alias("retries"),
        F.when(p % 29 == 0, 90000).otherwise(p % 10).cast("bigint").alias("retry_backoff_seconds"),
        _matrix(p).alias("matrix"),
    )


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline per 64 parts, with a few members each."""
    lane = F.floor(F.col("p") / 64).cast("bigint")
    q = F.col("p") % 64
    member = lambda cond: F.when(cond, F.struct("p", "base"))
    names = lambda column: F.transform(F.array_sort(column), lambda s: s["base"])
    grouped = (
        tasks(spark, sf_dir)
        .groupBy("project_id", lane.alias("lane"))
        .agg(
            F.collect_list(member((q % 16 == 1) & (lane % 9 != 4))).alias("t"),
            F.collect_list(member((q % 16 == 2) & (lane % 3 != 1))).alias("f"),
        )
    )
    return grouped.select(
        "project_id",
        F.when(F.col("lane") % 8 == 0, "ci").when(F.col("lane") % 8 == 5, "")
        .otherwise(F.concat(F.lit("lane-"), "lane")).alias("pipeline"),
        names("t").alias("tasks"),
        names("f").alias("finally"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per 512 parts."""
    p = F.col("p")
    return tasks(spark, sf_dir).where(p % PROJECT_TASKS == 0).select(
        "project_id",
        F.when(p % 3 == 1, 2).otherwise(1).cast("bigint").alias("schema"),
        F.when(p % 5 == 4, "").otherwise(F.concat(F.lit("Project "), p)).alias("project_name"),
        F.when(p % 7 == 2, "release").otherwise("ci").alias("default_pipeline"),
        F.create_map(
            F.lit("HOME"), F.concat(F.lit("/home/"), p), F.lit("PATH"), F.lit("/bin"),
            F.lit("LEVEL"), F.lit("ambient"),
        ).alias("environment"),
    )


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Known names per brand, and the same names with their second letter lost."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_brand").alias("project_id"), F.col("p_name").alias("candidate"))
    typed = part.select(
        F.col("p_brand").alias("project_id"),
        F.concat(
            F.substr("p_name", F.lit(1), F.lit(1)), F.substr("p_name", F.lit(3))
        ).alias("name"),
    )
    return typed, known


def paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page addresses as paths; some hosts and first folders hold a manifest."""
    bare = F.regexp_replace(F.regexp_replace("url", r"\A[a-z]+://", ""), r"[?#].*\z", "")
    pages = table(spark, sf_dir, "pages").select("page_id", bare.alias("path"))
    parts = F.split("path", "/")
    even = pages.where(F.col("page_id") % 2 == 0).select(parts[0].alias("root"))
    fifth = pages.where(F.col("page_id") % 5 == 0).select(
        F.concat_ws("/", parts[0], F.get(parts, F.lit(1))).alias("root")
    )
    return pages.select("path").distinct(), even.unionByName(fifth).distinct()


_BIG = "(SELECT list(n::VARCHAR ORDER BY n) FROM range(1, 41) r(n))"
SQL["v_task"] = f"""
  SELECT p, p_size, project_id,
    CASE WHEN p % 67 = 0 THEN 'task-[x' || p WHEN p % 71 = 0 THEN 'ta=sk-' || p ELSE 'task-' || p END
      AS base,
    CASE WHEN p % 37 = 0 THEN []::VARCHAR[] WHEN p % 41 = 0 THEN [''] ELSE
      ['build', 'pkg ' || p, '--os=${{os}}', 'it''s'] END AS command,
    list_filter([CASE WHEN q >= 1 THEN 'task-' || (p - q + q // 2) END,
      CASE WHEN q % 6 = 5 THEN 'task-' || (p - q + q // 3) || '[os=linux]' END,
      CASE WHEN q % 31 = 7 THEN 'nosuch-' || q END,
      CASE WHEN q % 29 = 3 THEN 'bad[ref' END], lambda x: x IS NOT NULL) AS depends_on,
    CASE p % 7 WHEN 0 THEN '../out' WHEN 1 THEN 'src/${{os}}' WHEN 2 THEN '/abs' END AS cwd,
    'l' || (p % 3) AS env_level,
    CASE WHEN p % 10 = 3 THEN '${{size}}-${{oops' ELSE '${{os}}' END AS env_os,
    CASE WHEN p % 5 = 0 THEN 'inherit' ELSE 'null' END AS stdin, p % 5 <> 1 AS cache,
    CASE p % 11 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['!a/**'] WHEN 2 THEN ['/abs/x', 'ok/*']
      WHEN 3 THEN ['a//b'] WHEN 4 THEN ['a/../b']
      ELSE ['src/' || p_type || '/**', '!src/tmp/**', 'conf/${{os}}.toml'] END AS inputs,
    CASE p % 13 WHEN 0 THEN ['!only'] WHEN 1 THEN [''] WHEN 2 THEN ['dist/${{os}}/app', 'dist/**']
      ELSE []::VARCHAR[] END AS outputs,
    CASE p % 17 WHEN 0 THEN ['A=B'] WHEN 1 THEN ['*'] WHEN 2 THEN ['HOME', 'CI', 'HOME', 'LEVEL']
      ELSE []::VARCHAR[] END AS cache_env,
    CASE WHEN p % 19 = 0 THEN 0 ELSE 600 END AS timeout_seconds,
    CASE WHEN p % 23 = 0 THEN 0 ELSE 16777216 END AS max_output_bytes,
    CASE p % 31 WHEN 0 THEN '' WHEN 1 THEN 'a:b' WHEN 2 THEN 'db' END AS resource_group,
    p % 3 AS retries, CASE WHEN p % 29 = 0 THEN 90000 ELSE p % 10 END AS retry_backoff_seconds,
    CASE WHEN p % 47 = 0 THEN [{{'k': 'os', 'vs': []::VARCHAR[]}}]
      WHEN p % 53 = 0 THEN [{{'k': 'os', 'vs': ['a', 'a']}}]
      WHEN p % 59 = 0 THEN [{{'k': 'os', 'vs': ['a=b', 'c']}}]
      WHEN p % 61 = 0 THEN [{{'k': 'a', 'vs': {_BIG}}}, {{'k': 'b', 'vs': {_BIG}}}]
      WHEN p % 4 = 0 THEN []
      WHEN p % 4 = 1 THEN [{{'k': 'os', 'vs': ['linux', 'mac']}}]
      WHEN p % 4 = 2 THEN [{{'k': 'os', 'vs': ['linux', 'mac']}}, {{'k': 'size', 'vs': ['s', 'm', 'l']}}]
      ELSE [{{'k': 'os', 'vs': ['linux', 'win']}}] END AS matrix
  FROM (SELECT p_partkey AS p, {_Q} AS q, 'proj-' || ({_P}) AS project_id, p_size, p_type FROM part)"""
SQL["v_dim"] = """
  SELECT project_id, base, d.k AS dim, d.vs AS vals
  FROM (SELECT project_id, base, unnest(matrix) AS d FROM v_task)"""
SQL["v_inst"] = """
  SELECT project_id, base, v1, v2, k1, k2, o1, o2,
    base || CASE WHEN k1 IS NULL THEN '' ELSE '[' || k1 || '=' || v1
      || coalesce(',' || k2 || '=' || v2, '') || ']' END AS task_id
  FROM (SELECT project_id, base, NULL AS k1, NULL AS v1, 0 AS o1, NULL AS k2, NULL AS v2, 0 AS o2
      FROM v_task WHERE len(matrix) = 0
    UNION ALL SELECT project_id, base, matrix[1].k, unnest(matrix[1].vs),
      unnest(range(len(matrix[1].vs))), NULL, NULL, 0 FROM v_task WHERE len(matrix) = 1
    UNION ALL SELECT project_id, base, matrix[1].k, v1, o1, matrix[2].k, unnest(matrix[2].vs),
      unnest(range(len(matrix[2].vs)))
      FROM (SELECT *, unnest(matrix[1].vs) AS v1, unnest(range(len(matrix[1].vs))) AS o1
        FROM v_task WHERE len(matrix) = 2 AND len(matrix[1].vs) * len(matrix[2].vs) <= 1024))"""
SQL["v_lane"] = """
  SELECT project_id, CASE WHEN lane % 8 = 0 THEN 'ci' WHEN lane % 8 = 5 THEN ''
      ELSE 'lane-' || lane END AS pipeline,
    coalesce(list(base ORDER BY p) FILTER (p % 64 % 16 = 1 AND lane % 9 <> 4), []) AS tasks,
    coalesce(list(base ORDER BY p) FILTER (p % 64 % 16 = 2 AND lane % 3 <> 1), []) AS fins
  FROM (SELECT *, p // 64 AS lane FROM v_task) GROUP BY project_id, lane"""
SQL["v_proj"] = f"""
  SELECT project_id, CASE WHEN p % 3 = 1 THEN 2 ELSE 1 END AS schema,
    CASE WHEN p % 5 = 4 THEN '' ELSE 'Project ' || p END AS project_name,
    CASE WHEN p % 7 = 2 THEN 'release' ELSE 'ci' END AS default_pipeline, p
  FROM v_task WHERE p % {PROJECT_TASKS} = 0"""
SQL["v_path"] = """
  SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path
  FROM pages"""
SQL["v_rootdir"] = """
  SELECT DISTINCT string_split(path, '/')[1] AS root FROM v_page WHERE page_id % 2 = 0
  UNION SELECT DISTINCT concat_ws('/', string_split(path, '/')[1], string_split(path, '/')[2])
  FROM v_page WHERE page_id % 5 = 0"""
SQL["v_page"] = """
  SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path
  FROM pages"""
_NEEDS.update({"v_dim": ["v_task"], "v_inst": ["v_task"], "v_lane": ["v_task"],
               "v_proj": ["v_task"], "v_rootdir": ["v_page"]})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project files: a source is a project, a document a file."""
    doc = F.col("doc_id")
    folder = F.when(doc % 40 == 3, ".git").otherwise(F.concat(F.lit("lang/"), "lang"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.concat(folder, F.lit("/"), doc, F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.when(doc % 2 == 0, 420).otherwise(493).cast("bigint").alias("mode"),
        F.sha2("text", 256).alias("sha256"),
        (doc % 50 == 7).alias("is_symlink"),
        doc.alias("doc_id"),
    )


def file_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per project and language, with ordered patterns."""
    lang = F.col("lang")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), "lang"
    ).distinct().select(
        "project_id",
        F.concat(F.lit("check-"), lang).alias("task_id"),
        F.array_compact(F.array(
            F.concat(F.lit("lang/"), lang, F.lit("/**")),
            F.concat(F.lit("!lang/"), lang, F.lit("/*1.txt")),
            F.lit("lang/*/10*.txt"),
            F.when(lang == "de", F.lit("docs/**/x.md")),
            F.when(lang == "es", F.lit("**/7?.txt")),
        )).alias("inputs"),
        F.array(F.lit("lang/**/*9.txt")).alias("outputs"),
        F.array(F.lit("HOME")).alias("cache_env"),
    )


SQL["v_file"] = """
  SELECT source AS project_id, CASE WHEN doc_id % 40 = 3 THEN '.git' ELSE 'lang/' || lang END
      || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size,
    CASE WHEN doc_id % 2 = 0 THEN 420 ELSE 493 END AS mode, sha256(text) AS sha256,
    doc_id % 50 = 7 AS is_symlink, doc_id, lang FROM documents"""
SQL["v_ftask"] = "SELECT DISTINCT source AS project_id, lang, 'check-' || lang AS task_id FROM documents"
SQL["v_fpat"] = """
  SELECT project_id, task_id, 0 AS idx, false AS exclude, '^lang/' || lang || '/' AS regex,
    'lang/' || lang || '/**' AS source FROM v_ftask
  UNION ALL SELECT project_id, task_id, 1, true, '^lang/' || lang || '/[^/]*1\\.txt$', '' FROM v_ftask
  UNION ALL SELECT project_id, task_id, 2, false, '^lang/[^/]*/10[^/]*\\.txt$', 'lang/*/10*.txt' FROM v_ftask
  UNION ALL SELECT project_id, task_id, 3, false, '^docs/(.*/)?x\\.md$', 'docs/**/x.md' FROM v_ftask
    WHERE lang = 'de'
  UNION ALL SELECT project_id, task_id, 3, false, '(^|/)7\\?\\.txt$', '**/7?.txt' FROM v_ftask
    WHERE lang = 'es'"""
SQL["v_match"] = """
  SELECT f.*, p.task_id, p.idx, p.exclude FROM v_file f JOIN v_fpat p USING (project_id)
  WHERE NOT starts_with(path, '.git/') AND regexp_matches(path, regex)"""
SQL["v_sel"] = """
  SELECT project_id, task_id, path, size, mode, sha256, is_symlink, doc_id FROM v_match
  GROUP BY ALL HAVING NOT arg_max(exclude, idx)"""
_NEEDS.update({"v_fpat": ["v_ftask"], "v_match": ["v_file", "v_fpat"], "v_sel": ["v_match"]})


def write_texts(texts: DataFrame, path: str) -> None:
    """One text per file, in folders by ``file``, written by all tasks."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts.select("file", F.col("text").alias("value")).repartition(tasks, "file").write.partitionBy(
        "file"
    ).text(path)


def release_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as found: a release is 64 consecutive documents of a source."""
    doc = F.col("doc_id")
    altered = F.when(doc % 101 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return _release_docs(spark, sf_dir).where(doc % 89 != 0).select(
        "release", "name", F.sha2(altered, 256).alias("sha256"),
        F.octet_length(altered).cast("bigint").alias("size"),
        F.when(doc % 61 == 5, "symlink").otherwise("file").alias("kind"),
        "doc_id",
    )


def release_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as recorded in manifests."""
    doc = F.col("doc_id")
    return _release_docs(spark, sf_dir).where(doc % 97 != 0).select(
        "release", "name", F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size"), "doc_id",
    )


def _release_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), F.floor(doc / 640).cast("bigint")).alias("release"),
        F.concat("lang", F.lit("/"), doc, F.lit(".txt")).alias("name"), "text", "doc_id",
    )


def checksum_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum lists of 64 documents each, some lines malformed."""
    doc = F.col("doc_id")
    digest = F.sha2("text", 256)
    name = F.concat("lang", F.lit("/"), doc, F.lit(".txt"))
    line = (
        F.when(doc % 31 == 0, F.concat(digest, F.lit(" "), name))
        .when(doc % 37 == 0, F.concat(F.lit("abc  "), name))
        .when(doc % 41 == 0, F.concat(digest, F.lit("  ../"), name))
        .when(doc % 43 == 0, F.concat(digest, F.lit("  *"), name))
        .when(doc % 47 == 0, F.concat(digest, F.lit("  same.txt\r\n"), digest, F.lit("  same.txt")))
        .when(doc % 53 == 0, "   ")
        .when(F.floor(doc / 64) % 5 == 4, "")
        .when(doc % 29 == 0, F.concat(F.upper(digest), F.lit("  "), name))
        .otherwise(F.concat(digest, F.lit("  "), name))
    )
    return (
        table(spark, sf_dir, "documents")
        .select(F.concat(F.lit("list-"), F.floor(doc / 64).cast("bigint")).alias("file"),
                "doc_id", line.alias("line"))
        .groupBy("file")
        .agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY doc_id)").alias("text"))
    )


def expected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of 64 expected names each, some malformed."""
    doc = F.col("doc_id")
    name = F.concat("lang", F.lit("/"), doc, F.lit(".txt"))
    line = (
        F.when(doc % 31 == 0, F.concat(F.lit("/"), name))
        .when(doc % 37 == 0, F.concat(F.lit("a/../"), name))
        .when(doc % 41 == 0, F.concat(F.lit("  "), name, F.lit(" \t")))
        .when(doc % 43 == 0, F.concat(name, F.lit("\n"), name))
        .when(doc % 53 == 0, "   ")
        .otherwise(name)
    )
    return (
        table(spark, sf_dir, "documents")
        .select(F.concat(F.lit("list-"), F.floor(doc / 64).cast("bigint")).alias("file"),
                "doc_id", line.alias("line"))
        .groupBy("file")
        .agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY doc_id)").alias("text"))
    )


CHANGELOG_ENTRIES = 16


def changelog_texts(
    spark: SparkSession, sf_dir: str, entries: int = CHANGELOG_ENTRIES
) -> DataFrame:
    """Changelogs: so many consecutive orders make a file, newest first."""
    k = F.col("o_orderkey")
    number = F.floor(k / entries).cast("bigint")
    patch = k % 100 + F.when(k % 83 == 0, 50).otherwise(0)
    version = F.concat_ws(
        ".", F.floor(k / 10000).cast("bigint"), (F.floor(k / 100) % 100).cast("bigint"), patch
    )
    heading = (
        F.when(k % 97 == 0, F.concat(F.lit("v"), version))
        .when((k % entries == entries - 1) & (number % 7 == 0), "(unreleased)")
        .when(k % 91 == 3, "(unreleased)")
        .otherwise(version)
    )
    date = F.when(k % 89 == 0, "2026-9-11").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    line_end = F.when(number % 5 == 0, "\r\n").otherwise("\n")
    body = F.when(k % 79 == 0, "").when(k % 73 == 0, F.concat(F.lit("\nReleased: "), date, F.lit("\n"))) \
        .otherwise(F.concat(F.lit("\nReleased: "), date, F.lit("\n\n- "), "o_orderpriority", F.lit("\n\n")))
    head = F.when(number % 31 == 0, "# Changes\n").otherwise("# Changelog\n\nAll notable changes.\n\n")
    entry = F.concat(F.lit("## "), heading, line_end, body)
    return (
        table(spark, sf_dir, "orders")
        .select(number.alias("number"), head.alias("head"), k.alias("k"), entry.alias("entry"))
        .groupBy("number", "head")
        .agg(F.expr("listagg(entry, '') WITHIN GROUP (ORDER BY k DESC)").alias("rest"))
        .select(F.concat(F.lit("team-"), "number").alias("file"),
                F.concat("head", "rest").alias("text"))
    )


def merge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge logs: 256 consecutive orders make a log."""
    k = F.col("o_orderkey")
    subject = F.when(k % 7 == 0, F.concat(F.lit(" Change "), "o_orderpriority")) \
        .when(k % 11 == 0, F.concat(F.lit("Merge pull request #x"), k, F.lit(" from a/b"))) \
        .otherwise(F.concat(F.lit("Merge pull request #"), k, F.lit(" from org/"), "o_orderpriority"))
    body = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("\n  Fix "), k, F.lit(" \nmore"))) \
        .when(F.col("o_orderstatus") == "O", " \n").otherwise("")
    record = F.when(k % 13 == 0, F.lit("\n")).otherwise(
        F.concat(subject, F.lit("\u001f"), body, F.lit("\u001e\n")))
    record = F.when(k % 13 == 0, F.concat(record, F.lit("\u001e"))).otherwise(record)
    return (
        table(spark, sf_dir, "orders")
        .select(F.floor(k / 256).cast("bigint").alias("number"), k.alias("k"), record.alias("record"))
        .groupBy("number")
        .agg(F.expr("listagg(record, '') WITHIN GROUP (ORDER BY k)").alias("text"))
        .select(F.concat(F.lit("log-"), "number").alias("file"), "text")
    )


def merge_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the orders in each merge log, in its order: file, numbers."""
    k = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.floor(k / 256).cast("bigint").alias("number"))
        .agg(F.array_sort(F.collect_list(k % 256)).alias("numbers"))
        .select(F.concat(F.lit("log-"), "number").alias("file"), "numbers")
    )


SQL["v_rdoc"] = """
  SELECT source || '-' || (doc_id // 640) AS release, lang || '/' || doc_id || '.txt' AS name,
    text, doc_id FROM documents"""
SQL["v_rfile"] = """
  SELECT release, name, sha256(t) AS sha256, strlen(t)::BIGINT AS size,
    CASE WHEN doc_id % 61 = 5 THEN 'symlink' ELSE 'file' END AS kind, doc_id
  FROM (SELECT *, CASE WHEN doc_id % 101 = 0 THEN text || '!' ELSE text END AS t FROM v_rdoc)
  WHERE doc_id % 89 <> 0"""
SQL["v_rexp"] = """
  SELECT release, name, sha256(text) AS sha256, strlen(text)::BIGINT AS size, doc_id FROM v_rdoc
  WHERE doc_id % 97 <> 0"""
def changelog_sql(entries: int) -> str:
    """Changelog entries, one row each, for files of so many orders."""
    return f"""
  SELECT k, number, 'team-' || number AS file, version,
    CASE WHEN k % 97 = 0 THEN 'v' || version WHEN k % {entries} = {entries - 1} AND number % 7 = 0 THEN '(unreleased)'
      WHEN k % 91 = 3 THEN '(unreleased)' ELSE version END AS heading,
    CASE WHEN k % 79 = 0 THEN '' WHEN k % 73 = 0 THEN chr(10) || 'Released: ' || date || chr(10)
      ELSE chr(10) || 'Released: ' || date || chr(10) || chr(10) || '- ' || o_orderpriority
        || chr(10) || chr(10) END AS body,
    row_number() OVER (PARTITION BY number ORDER BY k DESC) - 1 AS entry_no,
    CASE WHEN k % 79 = 0 THEN NULL ELSE date END AS date, o_orderpriority, major, minor, patch,
    k % 97 <> 0 AND NOT (k % {entries} = {entries - 1} AND number % 7 = 0) AND k % 91 <> 3 AS versioned
  FROM (SELECT o_orderkey AS k, o_orderkey // {entries} AS number, o_orderpriority,
    o_orderkey // 10000 AS major, (o_orderkey // 100) % 100 AS minor,
    o_orderkey % 100 + CASE WHEN o_orderkey % 83 = 0 THEN 50 ELSE 0 END AS patch,
    (o_orderkey // 10000) || '.' || ((o_orderkey // 100) % 100) || '.'
      || (o_orderkey % 100 + CASE WHEN o_orderkey % 83 = 0 THEN 50 ELSE 0 END) AS version,
    CASE WHEN o_orderkey % 89 = 0 THEN '2026-9-11' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date
    FROM orders)"""
SQL["v_cl"] = changelog_sql(CHANGELOG_ENTRIES)
SQL["v_clv"] = """
  SELECT file, -1 AS entry_no, 'title missing' AS rule, '' AS detail FROM v_cl
    WHERE number % 31 = 0 GROUP BY file
  UNION ALL SELECT file, entry_no, 'unknown heading', heading FROM v_cl
    WHERE NOT versioned AND heading <> '(unreleased)'
  UNION ALL SELECT file, entry_no, 'entry is empty', heading FROM v_cl WHERE versioned AND date IS NULL
  UNION ALL SELECT file, entry_no, 'release line', 'Released: ' || date FROM v_cl
    WHERE versioned AND date = '2026-9-11'
  UNION ALL SELECT file, entry_no, 'not newest first', heading FROM (
    SELECT *, lag({'a': major, 'b': minor, 'c': patch}) OVER (PARTITION BY file ORDER BY entry_no) AS prev
    FROM v_cl WHERE versioned) WHERE {'a': major, 'b': minor, 'c': patch} >= prev
  UNION ALL SELECT file, entry_no, CASE WHEN r > 1 THEN 'second unreleased'
      ELSE 'unreleased below the top' END, heading FROM (
    SELECT *, row_number() OVER (PARTITION BY file ORDER BY entry_no) AS r FROM v_cl
    WHERE heading = '(unreleased)') WHERE r > 1 OR entry_no > 0"""
SQL["v_merge"] = """
  SELECT 'log-' || (k // 256) AS file, k, subject, body, n, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN k END
      AS pr, o_orderpriority, o_orderstatus
  FROM (SELECT o_orderkey AS k, o_orderpriority, o_orderstatus,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Change ' || o_orderpriority
      WHEN o_orderkey % 11 = 0 THEN 'Merge pull request #x' || o_orderkey || ' from a/b'
      ELSE 'Merge pull request #' || o_orderkey || ' from org/' || o_orderpriority END AS subject,
    CASE o_orderstatus WHEN 'F' THEN chr(10) || '  Fix ' || o_orderkey || ' ' || chr(10) || 'more'
      ELSE '' END AS body, o_orderkey % 256 AS n FROM orders)
  WHERE k % 13 <> 0"""
_NEEDS.update({"v_rfile": ["v_rdoc"], "v_rexp": ["v_rdoc"], "v_clv": ["v_cl"]})
