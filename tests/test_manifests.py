"""Matrix, references, planning, lint and sources of manifests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import text
from runledger.operators import lint, planning
from runledger.operators import matrix as mx
from runledger.plans import project_plan
from runledger.sources.manifests import read_manifests

TASK = (
    "project_id string, base string, command array<string>, depends_on array<string>, cwd string, "
    "env map<string,string>, stdin string, cache boolean, inputs array<string>, "
    "outputs array<string>, cache_env array<string>, timeout_seconds bigint, "
    "max_output_bytes bigint, resource_group string, retries bigint, "
    "retry_backoff_seconds bigint, matrix map<string,array<string>>"
)


def task(base, **changes):
    row = {
        "project_id": "p", "base": base, "command": ["make"], "depends_on": [], "cwd": None,
        "env": {}, "stdin": "null", "cache": False, "inputs": [], "outputs": [], "cache_env": [],
        "timeout_seconds": 600, "max_output_bytes": 1024, "resource_group": None, "retries": 0,
        "retry_backoff_seconds": 0, "matrix": {},
    }
    return tuple({**row, **changes}.values())


def tasks(spark, *items):
    return spark.createDataFrame(list(items), TASK)


@pytest.mark.parametrize(
    "ref, base, dims, valid",
    [
        ("build", "build", [], True),
        ("build[os=mac,arch=x=1]", "build", [("arch", "x=1"), ("os", "mac")], True),
        ("build[os=mac", None, [], False),
        ("build[]", None, [], False),
        ("[os=mac]", None, [], False),
        ("build[os=]", None, [], False),
        ("build[=mac]", None, [], False),
        ("build[os]", None, [], False),
        ("build[os=mac,]", None, [], False),
        ("build[os=mac,os=win]", None, [], False),
    ],
)
def test_references(spark, ref, base, dims, valid):
    got = mx.parse_refs(spark.createDataFrame([(ref,)], "ref string")).first()
    assert (got.base, [tuple(d) for d in got.dims], got.valid) == (base, dims, valid)


def test_matrix_product_in_key_order(spark):
    got = mx.expand_matrix(tasks(
        spark, task("build", matrix={"os": ["linux", "mac"], "arch": ["x", "y"]}), task("lint")
    ))
    assert [r.task_id for r in got.collect()] == [
        "build[arch=x,os=linux]", "build[arch=x,os=mac]", "build[arch=y,os=linux]",
        "build[arch=y,os=mac]", "lint",
    ]


def test_dependent_inherits_dimensions(spark, rows):
    items = tasks(
        spark,
        task("build", matrix={"os": ["linux", "mac"]}),
        task("test", matrix={"os": ["linux", "mac"], "size": ["s", "m"]}, depends_on=["build"]),
        task("ship", depends_on=["build", "test[size=s,os=mac]"]),
        task("odd", matrix={"os": ["win"]}, depends_on=["build", "nope", "build[os=win]", "a[b"]),
    )
    edges, errors = mx.resolve_edges(mx.expand_matrix(items), items)
    assert rows(edges.where("task_id like 'test%'"), "task_id", "dep_id") == [
        ("test[os=linux,size=m]", "build[os=linux]"), ("test[os=linux,size=s]", "build[os=linux]"),
        ("test[os=mac,size=m]", "build[os=mac]"), ("test[os=mac,size=s]", "build[os=mac]"),
    ]
    ship = edges.where("task_id = 'ship'").orderBy("dep_pos").collect()
    assert [r.dep_id for r in ship] == ["build[os=linux]", "build[os=mac]", "test[os=mac,size=s]"]
    assert rows(errors, "ref", "error") == [
        ("a[b", "invalid reference"), ("build", "inherited value is missing"),
        ("build[os=win]", "unknown dimension or value"), ("nope", "unknown task"),
    ]


@pytest.mark.parametrize(
    "value, filled, error",
    [
        ("a-${os}-${os}", "a-x${size}-x${size}", None),
        ("plain $os }", "plain $os }", None),
        ("${nope}", None, "unknown placeholder nope"),
        ("${os} ${", None, "unterminated placeholder"),
        ("${nope} ${", None, "unknown placeholder nope"),
    ],
)
def test_interpolation_is_a_single_pass(spark, value, filled, error):
    rows = spark.createDataFrame(
        [(value, [("os", "x${size}"), ("size", "s")])],
        "v string, dims array<struct<key:string,value:string>>",
    )
    got = rows.select(mx.interpolate_text(F.col("v"), F.col("dims")).alias("r")).first().r
    assert (got.text, got.error) == (filled, error)


def test_plan_line(spark):
    items = tasks(
        spark,
        task("build", command=["cargo", "build --x", "it's"], env={"B": "1", "A": "2"},
             inputs=["src/**"], retries=2, retry_backoff_seconds=3, resource_group="db",
             depends_on=["base"]),
        task("base"),
    )
    pipelines = spark.createDataFrame(
        [("p", "ci", ["build"], ["base"])],
        "project_id string, pipeline string, tasks array<string>, `finally` array<string>",
    )
    built = project_plan.project_graph(items)
    plan = project_plan.plan_projects(built, items, pipelines).orderBy("level", "task_id").collect()
    assert [(r.task_id, r.finalizer, r.dep_count) for r in plan] == [("base", True, 0), ("build", False, 1)]
    assert plan[1].line == (
        "would run build in .: cargo 'build --x' 'it'\\''s' [timeout=600s] [max_output_bytes=1024]"
        " [resource_group=db] [inputs=src/**] [retries=2] [retry_backoff=3s]"
        " [env A=<redacted>] [env B=<redacted>]"
    )
    assert plan[0].line.endswith(" [finally]")


def test_lint_fields_reports_everything(spark, rows):
    items = tasks(
        spark,
        task("ok"),
        task("bad[x", command=["a\0b"], cache=True, stdin="inherit", cache_env=["A=B"],
             timeout_seconds=0, max_output_bytes=0, retries=1, retry_backoff_seconds=86401,
             resource_group="a:b", cwd="a/../b", env={"K": "v\0"}),
        task("empty", command=[""], cwd="/abs"),
        task("ctl\x07", command=[]),
    )
    lane = "project_id string, pipeline string, tasks array<string>, `finally` array<string>"
    pipelines = spark.createDataFrame([("p", "ci", [], ["ok"]), ("p", "b\n", ["ok"], [])], lane)
    project = "project_id string, schema bigint, project_name string, default_pipeline string"
    projects = spark.createDataFrame([("p", 1, "P", "ci"), ("q", 2, "", "ci")], project)
    got = rows(lint.lint_fields(items, pipelines, projects), "subject", "rule")
    assert got == sorted([
        ("q", "schema"), ("q", "project name"), ("q", "no pipelines"),
        ("ci", "pipeline without tasks"), ("b\n", "pipeline name"),
        ("bad[x", "task name characters"), ("bad[x", "NUL in command"),
        ("bad[x", "NUL in environment"), ("bad[x", "cacheable with inherited stdin"),
        ("bad[x", "cache_env name"), ("bad[x", "timeout is zero"), ("bad[x", "output limit is zero"),
        ("bad[x", "retry backoff"), ("bad[x", "resource group"), ("bad[x", "cwd"),
        ("empty", "command is empty"), ("empty", "cwd"),
        ("ctl\x07", "task name"), ("ctl\x07", "command is empty"),
    ], key=repr)


def test_lint_patterns_and_matrix(spark, rows):
    items = tasks(
        spark,
        task("a", cache=True, inputs=["!x"], outputs=["!y"]),
        task("b", inputs=["/abs", "", "!", "a//b", "a/../b", "ok/..x"]),
        task("c", matrix={"os": [], "e": ["a", "a"], "f": ["x=y"], "": ["1"]}),
        task("d", matrix={"a": [str(i) for i in range(33)], "b": [str(i) for i in range(32)]}),
        task("e", matrix={"a": [str(i) for i in range(32)], "b": [str(i) for i in range(32)]}),
    )
    assert rows(lint.lint_patterns(items), "subject", "rule", "detail") == sorted([
        ("a", "no positive input", ""), ("a", "no positive output", ""),
        ("b", "pattern empty or absolute", "/abs"), ("b", "pattern segment", "/abs"),
        ("b", "pattern empty or absolute", ""), ("b", "pattern empty or absolute", "!"),
        ("b", "pattern segment", "a//b"), ("b", "pattern segment", "a/../b"),
    ], key=repr)
    assert rows(lint.lint_matrix(items), "subject", "rule", "detail") == sorted([
        ("c", "empty dimension", "os"), ("c", "duplicate value", "e"), ("c", "dimension value", "f"),
        ("c", "dimension name", ""), ("d", "too many instances", "1056"),
    ], key=repr)


def test_suggestions_equal_brute_force(spark, rows):
    known = ["test", "build", "lint", "deploy", "deploys", "é", "ab", "abcd", "abcde", "", "builds"]
    typed = ["tests", "biuld", "lintt", "dep", "e", "b", "abc", "zzz", "test", "buildxx", "abcdefg"]
    # Lengths around and above the one from which names are found by segments.
    pick = random.Random(7)
    for length in [*range(20, 31), 60, 299]:
        word = "".join(pick.choice("abcé") for _ in range(length))
        known.append(word)
        for edits in (1, 2, 2, 3):
            letters = list(word)
            for _ in range(edits):
                at = pick.randrange(len(letters))
                letters[at : at + pick.randrange(2)] = pick.choice(["", "x", "yz"[: pick.randrange(2)]])
            typed.append("".join(letters))

    def distance(a, b):
        a, b = a.encode(), b.encode()
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            nxt = [i + 1]
            for j, y in enumerate(b):
                nxt.append(min(line[j] + (x != y), nxt[j] + 1, line[j + 1] + 1))
            line = nxt
        return line[-1]

    want = []
    for name in typed:
        allowed = 1 if len(name.encode()) <= 4 else 2
        near = [(distance(name, k), k) for k in known if k != name]
        near = sorted(p for p in near if p[0] <= allowed)
        if near:
            want.append((name, near[0][1]))
    got = lint.suggest_names(
        spark.createDataFrame([("p", t) for t in typed], "project_id string, name string"),
        spark.createDataFrame([("p", k) for k in known] + [("q", "tests")],
                              "project_id string, candidate string"),
    )
    assert rows(got, "name", "suggestion") == sorted(want, key=repr)


def test_nearest_root(spark, rows):
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("z/q",), ("a",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("a/b/c/d",)], "root string")
    assert rows(planning.nearest_root(paths, roots), "path", "root") == [
        ("a", "a"), ("a/b/c", "a/b"), ("a/x", "a"), ("z/q", None),
    ]


def test_manifests_get_defaults_and_unknown_fields(spark, rows, tmp_path):
    manifest = {
        "project_id": "p", "project": {"name": "P"},
        "tasks": {"a": {"command": ["x"]}},
        "pipelines": {"ci": {"tasks": ["a"]}},
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest) + "\n")
    projects, items, pipelines = read_manifests(spark, str(tmp_path))
    assert rows(projects) == [("p", 1, "P", schemas.DEFAULT_PIPELINE)]
    got = items.first()
    assert (got.timeout_seconds, got.max_output_bytes, got.stdin, got.cache, got.retries) == (
        600, 16 * 1024 * 1024, "null", False, 0)
    assert (got.matrix, got.env, got.inputs) == ({}, {}, [])
    assert rows(pipelines, "tasks", "finally") == [(["a"], [])]
    raw = {**manifest, "extra": 1, "tasks": {"a": {"command": [], "oops": 1}}}
    del raw["project_id"]
    frame = spark.createDataFrame([("p", json.dumps(raw))], "project_id string, manifest string")
    assert rows(lint.unknown_fields(frame)) == [
        ("p", "a", "unknown task field", "oops"), ("p", "p", "unknown manifest field", "extra"),
    ]


def test_quoting(spark):
    frame = spark.createDataFrame([(["a-b_.=/:+", "", "x y", "it's", "é"],)], "c array<string>")
    assert frame.select(text.quote_command("c")).first()[0] == "a-b_.=/:+  'x y' 'it'\\''s' 'é'"


@pytest.fixture
def plain_execution(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_tasks_of_one_file_are_expanded_by_many_tasks(spark, plain_execution):
    items = spark.range(100).selectExpr(
        "'p' AS project_id", "concat('t', id) AS base", "map('os', array('a', 'b')) AS matrix"
    ).coalesce(1)
    expanded = mx.expand_matrix(items).select("task_id", F.spark_partition_id().alias("part"))
    assert expanded.select("task_id").distinct().count() == 200
    assert expanded.select("part").distinct().count() > 1
