"""Content fingerprints and what they allow to skip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import globs, ordered, text
from runledger.operators.graph import _spread, _up
from runledger.session import scratch_path, settle

_TASK = ["project_id", "task_id"]
_DIGEST_BLOCKS = 4096
# Folders that never take part in a selection; add the tool's own state folder.
SKIPPED_FOLDERS = (".git",)


def _matches(
    files: DataFrame, tasks: DataFrame, patterns: str, skip: tuple[str, ...]
) -> DataFrame:
    """Paths beside every pattern of their project that matches: project_id, path, task_id, ``p``.

    Patterns are rows, compiled once. They meet files by the literal folder they
    start in and the literal name or ending they end with, so a file is only
    compared with patterns that can reach it. Only the path of a file takes part.
    Spark broadcasts the patterns when they are few; otherwise a crowded folder is
    split by the skew handling of adaptive execution.
    """
    compiled = tasks.select(
        *_TASK, F.explode(globs.compile_patterns(F.col(patterns))).alias("p")
    ).select(*_TASK, "p", F.col("p.folder").alias("_folder"), F.col("p.tail").alias("_tail"))
    visible = files.select("project_id", "path").where(
        ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(name) for name in skip]))
    )
    keyed = visible.withColumn("_folder", F.explode(globs.path_folders(F.col("path")))).withColumn(
        "_tail", F.explode(globs.path_tails(F.col("path")))
    )
    return (
        keyed.join(compiled, ["project_id", "_folder", "_tail"])
        .where(globs.matches(F.col("path"), F.col("p")))
        .select("project_id", "path", "task_id", "p")
    )


def _selected(files: DataFrame, tasks: DataFrame, patterns: str, skip: tuple[str, ...]) -> DataFrame:
    """Paths that the last matching pattern of a task selects: project_id, path, task_id."""
    return (
        _matches(files, tasks, patterns, skip)
        .groupBy("project_id", "path", "task_id")
        .agg(F.max_by(~F.col("p.exclude"), "p.idx").alias("_selected"))
        .where("_selected")
        .drop("_selected")
    )


def select_files(
    files: DataFrame,
    tasks: DataFrame,
    patterns: str = "inputs",
    skip: tuple[str, ...] = SKIPPED_FOLDERS,
) -> DataFrame:
    """Regular files selected by each task's ordered patterns.

    ``files``: project_id, path, is_symlink and any further columns, which are joined
    once the paths are chosen; a path stands once in its project.
    """
    regular = files.where(~F.col("is_symlink")).drop("is_symlink")
    chosen = _selected(regular, tasks, patterns, skip)
    return regular.join(chosen, ["project_id", "path"]).select(*regular.columns, "task_id")


def unmatched_patterns(
    files: DataFrame,
    tasks: DataFrame,
    patterns: str = "inputs",
    skip: tuple[str, ...] = SKIPPED_FOLDERS,
) -> DataFrame:
    """Positive patterns that match no regular file, excluded later or not."""
    regular = files.where(~F.col("is_symlink")).select("project_id", "path")
    matched = (
        _matches(regular, tasks, patterns, skip)
        .where(~F.col("p.exclude"))
        .select(*_TASK, F.col("p.idx").alias("idx"))
        .distinct()
    )
    declared = tasks.select(
        *_TASK, F.explode(globs.compile_patterns(F.col(patterns))).alias("p")
    ).where(~F.col("p.exclude"))
    return (
        declared.select(*_TASK, F.col("p.idx").alias("idx"), F.col("p.source").alias("pattern"))
        .join(matched, [*_TASK, "idx"], "left_anti")
    )


def symlink_matches(
    files: DataFrame,
    tasks: DataFrame,
    patterns: str = "inputs",
    skip: tuple[str, ...] = SKIPPED_FOLDERS,
) -> DataFrame:
    """The smallest selected symlink of each task that selects any."""
    links = files.where("is_symlink").select("project_id", "path")
    return (
        _selected(links, tasks, patterns, skip)
        .groupBy(*_TASK)
        .agg(F.min("path").alias("path"))
    )


def exclude_outputs(selected: DataFrame, tasks: DataFrame) -> DataFrame:
    """Inputs without the files the task itself declares as outputs."""
    outputs = tasks.select(*_TASK, globs.compile_patterns(F.col("outputs")).alias("compiled"))
    return (
        selected.join(outputs, _TASK)
        .where(~globs.selects(F.col("path"), F.col("compiled")))
        .drop("compiled")
    )


def select_environment(tasks: DataFrame, ambient: DataFrame) -> DataFrame:
    """Variables that count for a task: project_id, task_id, variable, value.

    ``*`` takes all ambient variables overlaid by the task's own; otherwise the
    named ones, the task's value first. ``ambient``: project_id, environment.
    """
    own, around = F.col("env"), F.col("environment")

    def pairs(mapping):
        return F.transform(
            F.map_entries(mapping),
            lambda e: F.struct(e["key"].alias("variable"), e["value"].alias("value")),
        )

    everything = F.concat(
        F.filter(pairs(around), lambda e: ~F.array_contains(F.map_keys(own), e["variable"])),
        pairs(own),
    )
    named = F.transform(
        F.array_distinct("cache_env"),
        lambda n: F.struct(
            n.alias("variable"),
            F.coalesce(own[n], around[n], F.lit(schemas.UNSET_VARIABLE)).alias("value"),
        ),
    )
    chosen = F.when(F.array_contains("cache_env", "*"), everything).otherwise(named)
    no_ambient = F.create_map().cast("map<string,string>")
    return (
        tasks.join(ambient.select("project_id", "environment"), "project_id", "left")
        .withColumn("environment", F.coalesce("environment", no_ambient))
        .select(*_TASK, F.explode(chosen).alias("e"))
        .select(*_TASK, "e.variable", "e.value")
    )


def input_digest(inputs: DataFrame) -> DataFrame:
    """One digest per task over path, size, mode and content of its inputs.

    Lengths are part of the text, so moving a byte between neighbours changes
    the digest. Files are spread over blocks by a hash of their path; blocks
    are hashed first, so a task with very many inputs needs no large group.
    """
    value = F.concat(
        text.framed(F.col("path")),
        text.framed(F.col("size").cast("string")),
        text.framed(F.coalesce(F.col("mode").cast("string"), F.lit(""))),
        text.framed(F.col("sha256")),
    )
    prefix = F.conv(F.substr(F.sha2("path", 256), F.lit(1), F.lit(3)), 16, 10).cast("bigint")
    return ordered.ordered_digest(
        inputs.withColumn("item", value), _TASK, "path", prefix % _DIGEST_BLOCKS, "item", "digest"
    )


def cacheable_tasks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``cacheable``: the task and all it depends on allow caching.

    The search runs upward from the tasks that do not, so its size is that of
    the answer and not of the full closure.
    """
    seeds = tasks.where(~F.col("cache")).select(*_TASK)
    tainted = _spread(_up(edges), seeds, [], "uncacheable").select(
        *_TASK, F.lit(True).alias("tainted")
    )
    return tasks.join(tainted, _TASK, "left").withColumn(
        "cacheable", F.col("tainted").isNull()
    ).drop("tainted")


def own_fingerprint(
    tasks: DataFrame, digests: DataFrame, environment: DataFrame, projects: DataFrame
) -> DataFrame:
    """Everything of a key except the dependencies: project_id, task_id, own.

    ``projects``: project_id, platform, manifest_sha256.
    """
    variables = environment.withColumn(
        "item", F.concat(text.framed(F.col("variable")), text.framed(F.col("value")))
    )
    prefix = F.conv(F.substr(F.sha2("variable", 256), F.lit(1), F.lit(3)), 16, 10).cast("bigint")
    env = ordered.ordered_digest(variables, _TASK, "variable", prefix, "item", "env_digest")
    rows = (
        tasks.join(projects.select("project_id", "platform", "manifest_sha256"), "project_id")
        .join(digests, _TASK, "left")
        .join(env, _TASK, "left")
    )
    settings = ["timeout_seconds", "max_output_bytes", "retries", "retry_backoff_seconds"]
    parts = [
        F.lit("task-key"),
        F.lit(str(schemas.FINGERPRINT_VERSION)),
        F.col("platform"),
        F.col("task_id"),
        F.coalesce("cwd", F.lit(".")),
        text.framed_list(F.col("command")),
        *[F.col(name).cast("string") for name in settings],
        F.coalesce("resource_group", F.lit("")),
        text.framed_list(F.col("inputs")),
        text.framed_list(F.col("outputs")),
        text.framed_list(F.col("cache_env")),
        F.col("manifest_sha256"),
        F.coalesce("env_digest", F.lit("")),
        F.coalesce("digest", F.lit("")),
    ]
    return rows.select(
        *_TASK, F.sha2(F.concat(*[text.framed(part) for part in parts]), 256).alias("own")
    )


def task_keys(own: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Keys that cover the keys of all dependencies: project_id, task_id, key.

    ``own`` comes from :func:`own_fingerprint` and holds the cacheable tasks;
    ``levels`` from ``plan_levels``. Level by level, new keys are pushed along
    the edges to the tasks that wait for them. Edges are stored by the level of
    their dependency and pushed keys by the level of the receiver, so every
    edge is read once and no earlier level is scanned again. A task without a
    level lies on a cycle or needs one that does; its key is null, and so it
    can never be found in a cache.
    """
    spark = own.sparkSession
    placed = levels.select(*_TASK, "level")
    nodes = settle(own.join(placed, _TASK), "key-nodes", ["level"])
    links = settle(
        edges.select(*_TASK, "dep_pos", "dep_id")
        .join(placed.withColumnRenamed("level", "task_level"), _TASK)
        .join(
            placed.select("project_id", F.col("task_id").alias("dep_id"),
                          F.col("level").alias("dep_level")),
            ["project_id", "dep_id"],
        ),
        "key-links",
        ["dep_level"],
    )
    keys_base, sent_base = scratch_path(spark, "keys"), scratch_path(spark, "key-parts")
    top = nodes.agg(F.max("level")).first()[0]
    unordered = own.select(*_TASK).join(placed.select(*_TASK), _TASK, "left_anti")
    keyless = unordered.withColumn("key", F.lit(None).cast("string"))
    if top is None:
        return keyless
    sent_schema = "project_id STRING, task_id STRING, dep_pos BIGINT, dep_key STRING, task_level BIGINT"
    key_schema = "project_id STRING, task_id STRING, key STRING, level BIGINT"
    links.limit(0).select(
        *_TASK, "dep_pos", F.lit("").alias("dep_key"), "task_level"
    ).write.partitionBy("task_level").parquet(sent_base)
    for level in range(top + 1):
        received = spark.read.schema(sent_schema).parquet(sent_base).where(
            F.col("task_level") == level
        )
        below = ordered.ordered_digest(
            received, _TASK, "dep_pos", ordered.block_of("dep_pos", _DIGEST_BLOCKS), "dep_key", "below"
        )
        nodes.where(F.col("level") == level).join(below, _TASK, "left").select(
            *_TASK, F.sha2(F.concat("own", F.coalesce("below", F.lit(""))), 256).alias("key")
        ).write.parquet(f"{keys_base}/level={level}")
        if level < top:
            new = spark.read.schema(key_schema).parquet(keys_base).where(F.col("level") == level)
            links.where(F.col("dep_level") == level).join(
                new.select("project_id", F.col("task_id").alias("dep_id"),
                           F.col("key").alias("dep_key")),
                ["project_id", "dep_id"],
            ).select(*_TASK, "dep_pos", "dep_key", "task_level").write.mode("append").partitionBy(
                "task_level"
            ).parquet(sent_base)
    return spark.read.schema(key_schema).parquet(keys_base).drop("level").unionByName(keyless)


def cache_decisions(
    keys: DataFrame, cache_index: DataFrame, stored: DataFrame, mode: str = "read_write"
) -> DataFrame:
    """Adds ``decision`` (hit, miss, skip) and ``reason`` to task keys.

    ``cache_index``: key, version, recorded_key, has_stdout, has_stderr,
    outputs (path, sha256). ``stored``: key, path, sha256 of what is there.
    ``mode``: read_write, no_cache or force.
    """
    if mode == "no_cache":
        return keys.withColumn("decision", F.lit("skip")).withColumn("reason", F.lit("no cache"))
    if mode == "force":
        return keys.withColumn("decision", F.lit("miss")).withColumn("reason", F.lit("forced"))
    if mode != "read_write":
        raise ValueError(f"unknown mode {mode!r}")
    expected = cache_index.select("key", F.explode("outputs").alias("o")).select(
        "key", "o.path", F.col("o.sha256").alias("wanted")
    )
    outputs = (
        expected.join(stored.select("key", "path", "sha256"), ["key", "path"], "left")
        .groupBy("key")
        .agg(
            F.bool_or(F.col("sha256").isNull()).alias("gone"),
            F.bool_or(F.coalesce(F.col("sha256") != F.col("wanted"), F.lit(False))).alias("changed"),
        )
    )
    entry = cache_index.select("key", "version", "recorded_key", "has_stdout", "has_stderr")
    reason = (
        F.when(F.col("version").isNull(), "no entry")
        .when(F.col("version") != schemas.FINGERPRINT_VERSION, "other version")
        .when(F.col("recorded_key") != F.col("key"), "other key")
        .when(~F.col("has_stdout") | ~F.col("has_stderr"), "output stream missing")
        .when(F.col("gone"), "output missing")
        .when(F.col("changed"), "output changed")
        .otherwise("ok")
    )
    return (
        keys.join(entry, "key", "left")
        .join(outputs, "key", "left")
        .withColumn("reason", reason)
        .withColumn("decision", F.when(F.col("reason") == "ok", "hit").otherwise("miss"))
        .drop("version", "recorded_key", "has_stdout", "has_stderr", "gone", "changed")
    )


def append_entries(cache_index: DataFrame, new: DataFrame) -> DataFrame:
    """Entries to add: the first writer of each key that is not stored yet.

    ``new``: key, written_at, writer and further orderable columns.
    """
    rest = [c for c in new.columns if c not in ("key", "written_at", "writer")]
    first = new.groupBy("key").agg(
        F.min(F.struct("written_at", "writer", *rest)).alias("first")
    )
    return first.join(cache_index.select("key"), "key", "left_anti").select("key", "first.*")


def unsafe_paths(outputs: DataFrame) -> DataFrame:
    """Recorded output paths that are empty, absolute or step upward."""
    reason = (
        F.when(F.col("path") == "", "empty")
        .when(text.is_absolute("path"), "absolute")
        .when(text.has_parent_step("path"), "parent step")
    )
    return outputs.withColumn("reason", reason).where(F.col("reason").isNotNull())
