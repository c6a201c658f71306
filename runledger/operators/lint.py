"""Manifest lint: every violation as project_id, subject, rule, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import text
from runledger.functions.rows import explode_rows
from runledger.operators import matrix as mx

_TASK_NAME_CHARS = r"[\[\]=,]"


def _violations(rows: DataFrame, subject: Column, rules: list[Column]) -> DataFrame:
    return explode_rows(
        rows.withColumn("subject", subject), ["project_id", "subject"], F.array(*rules), "v"
    ).select("project_id", "subject", "v.rule", "v.detail")


def _rule(broken: Column, rule: str, detail: Column | None = None) -> Column:
    detail = F.lit("") if detail is None else detail.cast("string")
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"),
                                                             detail.alias("detail")))


def lint_fields(tasks: DataFrame, pipelines: DataFrame, projects: DataFrame) -> DataFrame:
    """Field rules of projects, pipelines and tasks.

    tasks: project_id, base and the task columns. pipelines: project_id,
    pipeline, tasks, finally. projects: project_id, schema, project_name,
    default_pipeline.
    """
    with_lanes = pipelines.select("project_id", F.lit(True).alias("has_lane")).distinct()
    on_projects = _violations(
        projects.join(with_lanes, "project_id", "left"),
        F.col("project_id"),
        [
            _rule(F.col("schema") != schemas.MANIFEST_SCHEMA_VERSION, "schema", F.col("schema")),
            _rule(~text.is_identifier("project_name"), "project name"),
            _rule(~text.is_identifier("default_pipeline"), "default pipeline name"),
            _rule(F.col("has_lane").isNull(), "no pipelines"),
        ],
    )
    on_pipelines = _violations(
        pipelines,
        F.col("pipeline"),
        [
            _rule(~text.is_identifier("pipeline"), "pipeline name"),
            _rule(F.size("tasks") == 0, "pipeline without tasks"),
            _rule(
                F.exists(F.concat("tasks", "finally"), lambda r: ~text.is_identifier(r)),
                "task reference",
            ),
        ],
    )
    has_nul = lambda value: value.contains(text.NUL)
    group = F.col("resource_group")
    on_tasks = _violations(
        tasks,
        F.col("base"),
        [
            _rule(~text.is_identifier("base"), "task name"),
            _rule(F.col("base").rlike(_TASK_NAME_CHARS), "task name characters"),
            _rule(
                F.coalesce(F.get("command", F.lit(0)), F.lit("")) == "", "command is empty"
            ),
            _rule(F.exists("command", has_nul), "NUL in command"),
            _rule(
                F.exists(F.map_keys("env"), has_nul) | F.exists(F.map_values("env"), has_nul),
                "NUL in environment",
            ),
            _rule(F.col("cache") & (F.col("stdin") == "inherit"), "cacheable with inherited stdin"),
            _rule(
                F.exists(
                    "cache_env", lambda n: (n == "") | n.contains("=") | n.contains(text.NUL)
                ),
                "cache_env name",
            ),
            _rule(F.col("timeout_seconds") == 0, "timeout is zero"),
            _rule(F.col("max_output_bytes") == 0, "output limit is zero"),
            _rule(
                (F.col("retries") > 0)
                & (F.col("retry_backoff_seconds") > schemas.MAX_RETRY_BACKOFF_SECONDS),
                "retry backoff",
                F.col("retry_backoff_seconds"),
            ),
            _rule(
                group.isNotNull()
                & ((group == "") | group.contains(":") | group.rlike(text.CONTROL)),
                "resource group",
                group,
            ),
            _rule(
                F.col("cwd").isNotNull() & ~text.is_safe_relative("cwd"), "cwd", F.col("cwd")
            ),
        ],
    )
    return on_projects.unionByName(on_pipelines).unionByName(on_tasks)


def lint_patterns(tasks: DataFrame) -> DataFrame:
    """Input and output pattern rules."""
    positive = lambda p: ~p.startswith("!")
    missing = _violations(
        tasks,
        F.col("base"),
        [
            _rule(F.col("cache") & ~F.exists("inputs", positive), "no positive input"),
            _rule(
                (F.size("outputs") > 0) & ~F.exists("outputs", positive), "no positive output"
            ),
        ],
    )
    body = F.regexp_replace("pattern", r"\A!", "")
    each = tasks.select(
        "project_id", "base", F.explode(F.concat("inputs", "outputs")).alias("pattern")
    ).withColumn("body", body)
    broken = _violations(
        each,
        F.col("base"),
        [
            _rule(
                (F.col("body") == "")
                | text.is_absolute("body")
                | F.col("body").contains(text.NUL),
                "pattern empty or absolute",
                F.col("pattern"),
            ),
            _rule(
                (F.col("body") != "")
                & (F.exists(F.split("body", "/", -1), lambda s: (s == "") | (s == ".."))),
                "pattern segment",
                F.col("pattern"),
            ),
        ],
    )
    return missing.unionByName(broken)


def lint_matrix(tasks: DataFrame) -> DataFrame:
    """Matrix rules: names, empty or repeated values, characters, size."""
    size = mx.matrix_size(F.col("matrix"))
    whole = _violations(
        tasks,
        F.col("base"),
        [_rule(size > schemas.MAX_MATRIX_INSTANCES, "too many instances", size.cast("bigint"))],
    )
    dims = tasks.select("project_id", "base", F.explode("matrix").alias("dim", "values"))
    per_dim = _violations(
        dims,
        F.col("base"),
        [
            _rule(~text.is_identifier("dim"), "dimension name", F.col("dim")),
            _rule(F.size("values") == 0, "empty dimension", F.col("dim")),
            _rule(
                F.exists(
                    "values", lambda v: v.rlike(_TASK_NAME_CHARS) | v.rlike(text.CONTROL)
                ),
                "dimension value",
                F.col("dim"),
            ),
            _rule(
                F.size(F.array_distinct("values")) < F.size("values"),
                "duplicate value",
                F.col("dim"),
            ),
        ],
    )
    return whole.unionByName(per_dim)


def lint_references(tasks: DataFrame, pipelines: DataFrame, projects: DataFrame) -> DataFrame:
    """References that do not resolve: from tasks, from pipelines, defaults."""
    known = tasks.select("project_id", "base", "matrix").dropDuplicates(["project_id", "base"])
    from_tasks = tasks.select(
        "project_id",
        F.col("base").alias("subject"),
        F.explode("depends_on").alias("ref"),
        mx.no_dims().alias("fixed"),
    )
    from_lanes = pipelines.select(
        "project_id",
        F.col("pipeline").alias("subject"),
        F.explode(F.concat("tasks", "finally")).alias("ref"),
        mx.no_dims().alias("fixed"),
    )
    unresolved = (
        mx.resolve_references(from_tasks.unionByName(from_lanes), known)
        .where(F.col("error").isNotNull())
        .select("project_id", "subject", F.col("error").alias("rule"), F.col("ref").alias("detail"))
    )
    defaults = projects.join(
        pipelines.select("project_id", F.col("pipeline").alias("default_pipeline")),
        ["project_id", "default_pipeline"],
        "left_anti",
    ).select(
        "project_id",
        F.col("project_id").alias("subject"),
        F.lit("unknown default pipeline").alias("rule"),
        F.col("default_pipeline").alias("detail"),
    )
    finals = pipelines.select(
        "project_id", "pipeline", F.explode("finally").alias("ref")
    ).withColumn("base", mx.parse_ref(F.col("ref"))["base"])
    cached = finals.join(
        tasks.where("cache").select("project_id", "base"), ["project_id", "base"], "left_semi"
    ).select(
        "project_id",
        F.col("pipeline").alias("subject"),
        F.lit("cacheable finalizer").alias("rule"),
        F.col("ref").alias("detail"),
    )
    return unresolved.unionByName(defaults).unionByName(cached)


def _deletions(name: Column, depth: int) -> Column:
    """The byte string and all strings that arise by deleting up to ``depth`` bytes."""
    shortened = F.array(name)
    found = shortened
    for _ in range(depth):
        shortened = F.array_distinct(
            F.flatten(
                F.transform(
                    shortened,
                    lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(
                        F.transform(
                            F.sequence(F.lit(1), F.length(s)),
                            lambda i: F.concat(
                                F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)
                            ),
                        )
                    ),
                )
            )
        )
        found = F.concat(found, shortened)
    return F.array_distinct(found)


# Names of at most so many bytes are found by shortened texts, longer ones by segments.
_SHORT_NAME = 24
_SEGMENTS = 3


def _segment_start(length: Column, number: Column | int) -> Column:
    return F.floor(length * number / _SEGMENTS).cast("int")


def _segment_key(length: Column, number: Column, segment: Column) -> Column:
    return F.concat_ws(":", length, number, segment)


def _segments(name: Column) -> Column:
    """The thirds of a candidate, with its length and their number."""
    length = F.length(name)

    def key(k: Column) -> Column:
        start, end = _segment_start(length, k), _segment_start(length, k + 1)
        return _segment_key(length, k, F.substr(name, start + 1, end - start))

    return F.transform(F.sequence(F.lit(0), F.lit(_SEGMENTS - 1)), key)


def _possible_segments(name: Column) -> Column:
    """The keys of all candidates within two edits: one of three segments is untouched,
    and stands at most two bytes from its place in the candidate."""
    around = F.sequence(F.lit(-2), F.lit(2))

    def of_length(change: Column) -> Column:
        length = F.length(name) + change

        def of_segment(k: Column) -> Column:
            start, end = _segment_start(length, k), _segment_start(length, k + 1)

            def at(shift: Column) -> Column:
                fits = (start + shift >= 0) & (end + shift <= F.length(name))
                return F.when(
                    fits, _segment_key(length, k, F.substr(name, start + shift + 1, end - start))
                )

            return F.transform(around, at)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_SEGMENTS - 1)), of_segment))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(around, of_length))))


def suggest_names(unknown: DataFrame, candidates: DataFrame) -> DataFrame:
    """Nearest candidate within the project: project_id, name, suggestion.

    Up to one byte edit for names of at most four bytes, else two; ties go to
    the smaller name, and the name itself never counts. Two texts within that
    distance share a text that arises by deleting as many bytes from each, so
    an equality join on those shortened texts finds every pair without ever
    pairing up a whole project. Long names have very many shortened texts; they
    are joined by thirds of the candidate, of which two edits leave one intact.
    """
    typed = unknown.select("project_id", "name").distinct()
    name_bytes = text.bytes_as_chars(F.col("name"))
    allowed = F.when(F.length(name_bytes) <= 4, 1).otherwise(2)
    wanted = explode_rows(
        typed.withColumn("allowed", allowed),
        ["project_id", "name", "allowed"],
        F.when(allowed == 1, _deletions(name_bytes, 1))
        .when(F.length(name_bytes) <= _SHORT_NAME, _deletions(name_bytes, 2))
        .otherwise(_possible_segments(name_bytes)),
        "short",
    )
    # Lengths differ by two at most, so around the limit a candidate is offered both ways.
    none = F.array().cast("array<string>")
    offered_bytes = text.bytes_as_chars(F.col("candidate"))
    offered_length = F.length(offered_bytes)
    offered = explode_rows(
        candidates.select("project_id", "candidate").distinct(),
        ["project_id", "candidate"],
        F.concat(
            F.when(offered_length <= _SHORT_NAME + 2, _deletions(offered_bytes, 2)).otherwise(none),
            F.when(offered_length > _SHORT_NAME - 2, _segments(offered_bytes)).otherwise(none),
        ),
        "short",
    )
    distance = text.byte_distance(F.col("name"), F.col("candidate"))
    return (
        wanted.join(offered, ["project_id", "short"])
        .where(F.col("name") != F.col("candidate"))
        .withColumn("distance", distance)
        .where(F.col("distance") <= F.col("allowed"))
        .groupBy("project_id", "name")
        .agg(F.min(F.struct("distance", "candidate")).alias("best"))
        .select("project_id", "name", F.col("best.candidate").alias("suggestion"))
    )


def unknown_fields(raw: DataFrame) -> DataFrame:
    """Undeclared keys in raw manifest JSON, at each of the four levels.

    ``raw``: project_id, manifest (JSON text). The key that tells the manifests
    of a fleet apart is declared; text that is no JSON object is a violation.
    """
    as_map = lambda column: F.from_json(column, "map<string,string>")
    top = raw.select("project_id", as_map(F.col("manifest")).alias("m"))

    def undeclared(rows: DataFrame, level: str, subject: Column, keys: Column, known: list[str]):
        extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")),
                               F.array(*[F.lit(k) for k in known]))
        return rows.select(
            "project_id", subject.alias("subject"), F.explode(extra).alias("detail")
        ).select("project_id", "subject", F.lit(f"unknown {level} field").alias("rule"), "detail")

    def children(field: str) -> DataFrame:
        return top.select(
            "project_id", F.explode(as_map(F.col("m")[field])).alias("name", "body")
        ).withColumn("b", as_map(F.col("body")))

    broken = top.where(F.col("m").isNull()).select(
        "project_id", F.col("project_id").alias("subject"),
        F.lit("malformed manifest").alias("rule"), F.lit("").alias("detail"),
    )
    declared = [*schemas.MANIFEST_KEYS, schemas.FLEET_KEY]
    found = [
        broken,
        undeclared(top, "manifest", F.col("project_id"), F.map_keys("m"), declared),
        undeclared(
            top,
            "project",
            F.col("project_id"),
            F.map_keys(as_map(F.col("m")["project"])),
            schemas.PROJECT_KEYS,
        ),
        undeclared(children("tasks"), "task", F.col("name"), F.map_keys("b"), schemas.TASK_KEYS),
        undeclared(
            children("pipelines"), "pipeline", F.col("name"), F.map_keys("b"), schemas.PIPELINE_KEYS
        ),
    ]
    result = found[0]
    for rows in found[1:]:
        result = result.unionByName(rows)
    return result
