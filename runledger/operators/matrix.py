"""Task references and matrix expansion.

A matrix is a map of dimension to values. Instances are built inside the row
by array expressions (at most 1,024 of them). Manifests are small files and their
expansion is long work, so tasks are dealt out before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.rows import explode_rows

_DIMS = "array<struct<key:string,value:string>>"
_PLACEHOLDER = r"\$\{([^}]*)\}"


def no_dims() -> Column:
    return F.array().cast(_DIMS)


def parse_ref(ref: Column) -> Column:
    """``STRUCT<base, dims, valid>`` of ``base`` or ``base[k=v,k=v]``.

    ``dims`` is a list of key and value in key order.
    """
    bracket = F.instr(ref, "[")
    body = F.substr(ref, bracket + 1, F.length(ref) - bracket - 1)

    def pair(text: Column) -> Column:
        at = F.instr(text, "=")
        return F.struct(
            F.substr(text, F.lit(1), at - 1).alias("key"),
            F.substr(text, at + 1).alias("value"),
            (at > 1).alias("ok"),
        )

    pairs = F.transform(F.split(body, ",", -1), pair)
    keys = F.transform(pairs, lambda p: p["key"])
    pairs_ok = F.forall(pairs, lambda p: p["ok"] & (p["value"] != "")) & (
        F.size(F.array_distinct(keys)) == F.size(keys)
    )
    bracketed = bracket > 0
    valid = ~bracketed | ((bracket > 1) & ref.endswith("]") & (body != "") & pairs_ok)
    dims = F.array_sort(
        F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    )
    return F.struct(
        F.when(valid, F.when(bracketed, F.substr(ref, F.lit(1), bracket - 1)).otherwise(ref))
        .alias("base"),
        F.when(valid & bracketed, dims).otherwise(no_dims()).alias("dims"),
        valid.alias("valid"),
    )


def format_id(base: Column, dims: Column) -> Column:
    """``base[k=v,k=v]`` with the keys in order, or the bare base."""
    inner = F.array_join(
        F.transform(dims, lambda d: F.concat(d["key"], F.lit("="), d["value"])), ","
    )
    return F.when(F.size(dims) == 0, base).otherwise(
        F.concat(base, F.lit("["), inner, F.lit("]"))
    )


def dim_value(dims: Column, key: Column) -> Column:
    """Value of a dimension, or null."""
    return F.get(F.filter(dims, lambda d: d["key"] == key), F.lit(0))["value"]


def matrix_size(matrix: Column) -> Column:
    """Instances a matrix expands to; exact far beyond the allowed bound."""
    return F.aggregate(
        F.map_values(matrix),
        F.lit(1).cast("double"),
        lambda size, values: size * F.size(values),
    )


def is_expandable(matrix: Column) -> Column:
    return matrix_size(matrix) <= schemas.MAX_MATRIX_INSTANCES


def matrix_instances(matrix: Column, fixed: Column) -> Column:
    """All dimension lists of a matrix, the ``fixed`` dimensions pinned.

    Null if the matrix is too large; empty if a pinned value does not exist.
    """
    entries = F.array_sort(F.map_entries(matrix))

    def selected(entry: Column) -> Column:
        pinned = dim_value(fixed, entry["key"])
        return F.filter(entry["value"], lambda v: pinned.isNull() | (v == pinned))

    start = F.array(no_dims())
    product = F.aggregate(
        entries,
        start,
        lambda built, entry: F.flatten(
            F.transform(
                built,
                lambda dims: F.transform(
                    selected(entry),
                    lambda v: F.concat(
                        dims, F.array(F.struct(entry["key"].alias("key"), v.alias("value")))
                    ),
                ),
            )
        ),
    )
    return F.when(is_expandable(matrix), product)


def parse_refs(refs: DataFrame, column: str = "ref") -> DataFrame:
    """Split references into base and dimensions and tell whether they are valid."""
    parsed = parse_ref(F.col(column))
    return refs.withColumn("parsed", parsed).select(
        *refs.columns, "parsed.base", "parsed.dims", "parsed.valid"
    )


def expand_matrix(tasks: DataFrame) -> DataFrame:
    """One row per instance: adds ``dims`` and ``task_id`` (``base`` is the name).

    Tasks with more than 1,024 instances are refused: see :func:`matrix_rejects`.
    """
    dealt = tasks.repartition("project_id", "base")
    return explode_rows(
        dealt, tasks.columns, matrix_instances(F.col("matrix"), no_dims()), "dims"
    ).withColumn("task_id", format_id(F.col("base"), F.col("dims")))


def matrix_rejects(tasks: DataFrame) -> DataFrame:
    """The tasks that :func:`expand_matrix` refuses: project_id, base, instances, reason."""
    size = matrix_size(F.col("matrix"))
    return tasks.where(~is_expandable(F.col("matrix"))).select(
        "project_id", "base", size.cast("bigint").alias("instances"),
        F.lit("matrix too large").alias("reason"),
    )


def interpolate_text(text: Column, dims: Column) -> Column:
    """``STRUCT<text, error>`` after one left-to-right pass over ``${key}``."""
    plain = F.struct(text.alias("text"), F.lit(None).cast("string").alias("error"))
    literals = F.split(text, r"\$\{[^}]*\}", -1)
    keys = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(1))
    values = F.transform(keys, lambda key: dim_value(dims, key))
    unknown = F.get(F.filter(keys, lambda key: dim_value(dims, key).isNull()), F.lit(0))
    open_end = F.element_at(literals, -1).contains("${")
    error = F.when(
        unknown.isNotNull(), F.concat(F.lit("unknown placeholder "), unknown)
    ).when(open_end, F.lit("unterminated placeholder"))
    filled = F.array_join(
        F.zip_with(literals, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    full = F.struct(F.when(error.isNull(), filled).alias("text"), error.alias("error"))
    return F.when(~text.contains("${"), plain).otherwise(full)


def interpolate(instances: DataFrame) -> DataFrame:
    """Fill placeholders in command, cwd, env values, inputs and outputs.

    Adds ``errors``, the distinct problems of the row; a value that has one
    becomes null.
    """
    dims = F.col("dims")

    def each(column: str) -> Column:
        return F.transform(F.col(column), lambda value: interpolate_text(value, dims))

    work = instances.select(
        "*",
        each("command").alias("_command"),
        each("inputs").alias("_inputs"),
        each("outputs").alias("_outputs"),
        interpolate_text(F.coalesce("cwd", F.lit(".")), dims).alias("_cwd"),
        F.transform_values("env", lambda _, value: interpolate_text(value, dims)).alias("_env"),
    )
    lists = ["command", "inputs", "outputs"]
    errors = F.concat(
        *[F.transform(F.col(f"_{name}"), lambda r: r["error"]) for name in lists],
        F.array("_cwd.error"),
        F.transform(F.map_values("_env"), lambda r: r["error"]),
    )
    done = work.withColumn("errors", F.array_distinct(F.array_compact(errors)))
    for name in lists:
        done = done.withColumn(name, F.transform(F.col(f"_{name}"), lambda r: r["text"]))
    return (
        done.withColumn("cwd", F.col("_cwd.text"))
        .withColumn("env", F.transform_values("_env", lambda _, r: r["text"]))
        .drop("_command", "_inputs", "_outputs", "_cwd", "_env")
    )


def _reference_error() -> Column:
    ref, matrix = F.col("parsed"), F.col("dep_matrix")
    explicit = F.size(ref["dims"]) > 0
    bad_value = F.exists(
        ref["dims"],
        lambda d: ~F.coalesce(F.array_contains(F.element_at(matrix, d["key"]), d["value"]), F.lit(False)),
    )
    return (
        F.when(~ref["valid"], "invalid reference")
        .when(F.col("dep_base").isNull(), "unknown task")
        .when(explicit & (F.size(matrix) == 0), "task has no matrix")
        .when(explicit & (F.size(ref["dims"]) != F.size(matrix)), "not every dimension given")
        .when(explicit & bad_value, "unknown dimension or value")
        .when(~is_expandable(matrix), "matrix too large")
        .when(~explicit & (F.size("targets") == 0), "inherited value is missing")
    )


def resolve_references(references: DataFrame, tasks: DataFrame) -> DataFrame:
    """Join references with the tasks they name.

    ``references``: project_id, ref, fixed (dimensions to inherit), other
    columns. ``tasks``: project_id, base, matrix, one row per task. Adds
    ``targets`` (task ids, in order) and ``error``.
    """
    named = tasks.select(
        "project_id", F.col("base").alias("dep_base"), F.col("matrix").alias("dep_matrix")
    )
    joined = references.withColumn("parsed", parse_ref(F.col("ref"))).join(
        named.withColumnRenamed("project_id", "_project"),
        (F.col("project_id") == F.col("_project")) & (F.col("parsed.base") == F.col("dep_base")),
        "left",
    )
    base = F.col("parsed.base")
    explicit = F.size("parsed.dims") > 0
    targets = F.when(explicit, F.array(format_id(base, F.col("parsed.dims")))).otherwise(
        F.transform(
            matrix_instances(F.col("dep_matrix"), F.col("fixed")),
            lambda dims: format_id(base, dims),
        )
    )
    resolved = joined.withColumn("targets", targets).withColumn("error", _reference_error())
    return resolved.drop("_project", "dep_base", "dep_matrix", "parsed")


def resolve_edges(instances: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependency edges between instances, and the references that fail.

    An explicit instance names itself (its id is written with the dimensions in
    key order); a bare name stands for all instances of that task which agree
    with the dependent on the dimensions they share. ``tasks`` has one row per
    project_id and base, also for tasks that expand to nothing.
    """
    references = instances.select(
        "project_id",
        "task_id",
        F.col("dims").alias("fixed"),
        F.posexplode("depends_on").alias("ref_pos", "ref"),
    )
    resolved = resolve_references(references, tasks)
    # Positions are dense: the targets of a reference follow those of the references
    # before it. These come from one row of their task, so the window is small.
    earlier = (
        Window.partitionBy("project_id", "task_id").orderBy("ref_pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.size("targets")).over(earlier), F.lit(0))
    edges = explode_rows(
        resolved.where(F.col("error").isNull()).select("project_id", "task_id", "targets", start.alias("start")),
        ["project_id", "task_id", "start"],
        "targets",
        "dep_id",
        "i",
    )
    return (
        edges.select("project_id", "task_id", (F.col("start") + F.col("i")).alias("dep_pos"), "dep_id"),
        resolved.where(F.col("error").isNotNull()).select("project_id", "task_id", "ref", "error"),
    )
