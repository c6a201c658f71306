"""Whole jobs from manifests and files to plans and cache keys."""

import json

import pytest
from pyspark.sql import functions as F

from runledger.plans import project_plan as pp
from runledger.sources import documents, manifests

TASK = {"command": ["make"], "timeout_seconds": 60}
MANIFEST = {
    "project_id": "p",
    "project": {"name": "P", "default_pipeline": "ci"},
    "pipelines": {"ci": {"tasks": ["test"], "finally": ["report"]}},
    "tasks": {
        "build": {**TASK, "cache": True, "inputs": ["src/**", "!src/*.md"], "outputs": ["out/${os}/**"],
                  "matrix": {"os": ["linux", "mac"]}},
        "test": {**TASK, "cache": True, "inputs": ["test/**"], "outputs": ["res"], "depends_on": ["build"]},
        "report": {**TASK, "command": ["echo", "a b"]},
        "alone": {**TASK, "depends_on": ["gone"]},
    },
}
FILES = {"src/a.rs": "1", "src/x.md": "1", "test/t": "1", "docs/d": "1", "out/linux/o": "1"}


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("manifests") / "m.json"
    path.write_text(json.dumps(MANIFEST) + "\n")
    projects, tasks, pipelines = manifests.read_manifests(spark, str(path))
    return projects, tasks, pipelines, pp.project_graph(tasks)


def keys(spark, built, platform="linux", **changed):
    files = {**FILES, **{k.replace("__", "/").replace("_", "."): v for k, v in changed.items()}}
    table = spark.createDataFrame(
        [("p", path, False, len(d), 420, d) for path, d in files.items()],
        "project_id string, path string, is_symlink boolean, size bigint, mode bigint, sha256 string",
    )
    projects = spark.createDataFrame(
        [("p", platform, "m", {"HOME": "/h"})],
        "project_id string, platform string, manifest_sha256 string, environment map<string,string>",
    )
    return {r.task_id: r.key for r in pp.key_projects(built, table, projects).collect()}


def test_plan_of_a_project(fleet):
    projects, tasks, pipelines, built = fleet
    plan = {r.task_id: r for r in pp.plan_projects(built, tasks, pipelines).collect()}
    assert {t: (r.level, r.finalizer, r.reason) for t, r in plan.items()} == {
        "build[os=linux]": (0, False, None), "build[os=mac]": (0, False, None),
        "test": (1, False, None), "report": (0, True, None),
    }
    assert plan["report"].line.startswith("would run report in .: echo 'a b'")


def test_plan_document_round_trip(spark, fleet, tmp_path):
    projects, tasks, pipelines, built = fleet
    path = str(tmp_path / "plans")
    documents.write_plan_documents(pp.plan_projects(built, tasks, pipelines), built.edges, path)
    read = documents.read_documents(spark, path)["plan"].orderBy("plan_pos").collect()
    assert [(r.plan_pos, r.id, r.depends_on) for r in read] == [
        (0, "build[os=linux]", []), (1, "build[os=mac]", []), (2, "report", []),
        (3, "test", ["build[os=linux]", "build[os=mac]"]),
    ]
    assert read[0].outputs == ["out/linux/**"] and read[2].finalizer and read[3].timeout_seconds == 60


def test_documents_of_many_lines(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "LINE_ITEMS", 4)
    n = 23
    tasks = spark.range(n).select(
        F.lit("p").alias("project_id"), F.format_string("t%02d", "id").alias("base"),
        F.array(F.lit("run")).alias("command"), F.lit("null").alias("stdin"),
    )
    lanes = spark.range(9).select(
        F.lit("p").alias("project_id"), F.concat(F.lit("lane-"), "id").alias("pipeline"),
        F.array(F.lit("t01")).alias("tasks"), F.array(F.lit("t02")).alias("finally"),
    )
    projects = spark.createDataFrame(
        [("p", "P", "ci"), ("empty", "E", "go")], "project_id string, project_name string, default_pipeline string"
    )
    path = str(tmp_path / "lists")
    documents.write_list_documents(projects, tasks, lanes, path)
    (tmp_path / "lists" / "later.json").write_text(
        '{"schema":2,"kind":"list","project":"new"}\n{"schema":1,"kind":"other","project":"x"}\n'
    )
    read = documents.read_documents(spark, path)
    assert rows(read["list"], "project", "id") == [("P", f"t{k:02}") for k in range(n)]
    assert rows(read["pipelines"], "project", "name", "tasks", "finally") == [
        ("P", f"lane-{k}", ["t01"], ["t02"]) for k in range(9)
    ]
    assert rows(read["projects"]) == [("E", "/empty", "go"), ("P", "/p", "ci")]
    assert rows(read["others"], "schema", "kind", "project") == [(1, "other", "x"), (2, "list", "new")]
    longest = spark.read.text(path).select(F.max(F.size(F.split("value", '"id"')) - 1)).first()[0]
    assert longest == 4


def test_plans_of_two_pipelines_are_told_apart(spark, fleet, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "LINE_ITEMS", 2)
    projects, tasks, pipelines, built = fleet
    plan = pp.plan_projects(built, tasks, pipelines)
    path = str(tmp_path / "plans")
    documents.write_plan_documents(plan.unionByName(plan.withColumn("pipeline", F.lit("again"))), built.edges, path)
    read = documents.read_documents(spark, path)["plan"]
    names = sorted({r.pipeline for r in plan.collect()} | {"again"})
    assert rows(read, "pipeline", "plan_pos") == [(name, k) for name in names for k in range(4)]


def test_problems_of_a_project(fleet):
    projects, tasks, pipelines, built = fleet
    found = {(r.subject, r.rule, r.detail) for r in pp.check_projects(projects, tasks, pipelines).collect()}
    assert ("alone", "unknown task", "gone") in found


def test_keys_follow_inputs_and_dependencies(spark, fleet):
    built = fleet[3]
    first = keys(spark, built)
    assert set(first) == {"build[os=linux]", "build[os=mac]", "test"} and len(set(first.values())) == 3
    assert keys(spark, built) == first
    assert keys(spark, built, docs__d="2") == first  # no input of any task
    assert keys(spark, built, src__x_md="2") == first  # excluded
    tested = keys(spark, built, test__t="2")
    assert {t for t in first if tested[t] != first[t]} == {"test"}
    built_anew = keys(spark, built, src__a_rs="2")
    assert all(built_anew[t] != first[t] for t in first)
    assert all(keys(spark, built, platform="mac")[t] != first[t] for t in first)
