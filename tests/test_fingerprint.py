"""Patterns, environments, digests, keys and cache decisions."""

import pytest
from pyspark.sql import functions as F

from runledger.functions import globs
from runledger.operators import fingerprint as fp
from runledger.operators import graph

FILE = "project_id string, path string, size bigint, mode bigint, sha256 string, is_symlink boolean"
TASK = (
    "project_id string, task_id string, inputs array<string>, outputs array<string>, "
    "cache_env array<string>, env map<string,string>"
)


def files(spark, *paths, links=()):
    return spark.createDataFrame(
        [("p", path, 1, 420, path * 2, path in links) for path in [*paths, *links]], FILE
    )


def tasks(spark, inputs, outputs=(), cache_env=(), env=None):
    return spark.createDataFrame(
        [("p", "t", list(inputs), list(outputs), list(cache_env), env or {})], TASK
    )


def test_last_matching_pattern_decides(spark, rows):
    found = fp.select_files(
        files(spark, "src/a", "src/generated/x", "src/generated/keep.txt", "b", ".git/src/a"),
        tasks(spark, ["src/**", "!src/generated/**", "src/generated/keep.txt", "**/a"]),
    )
    assert rows(found, "path") == [("src/a",), ("src/generated/keep.txt",)]


@pytest.mark.parametrize(
    "pattern, path, matches",
    [
        ("src/**/Cargo.toml", "src/Cargo.toml", True),
        ("src/**/Cargo.toml", "src/a/b/Cargo.toml", True),
        ("src/**/Cargo.toml", "src/a/Cargo.tomlx", False),
        ("*.rs", "a.rs", True),
        ("*.rs", "a/b.rs", False),
        ("a*c*e", "abcde", True),
        ("a*c*e", "abde", False),
        ("a?[b]", "a?[b]", True),
        ("a?[b]", "axb", False),
        ("a.b", "axb", False),
        ("**", "x/y", True),
        ("src/**", "src", True),
        ("a**b", "a/b", False),
        ("a**b", "axxb", True),
        ("**/**/x", "x", True),
        ("é-*", "é-ü", True),
        ("a{1}(b)+^$|\\", "a{1}(b)+^$|\\", True),
    ],
)
def test_patterns(spark, pattern, path, matches):
    frame = spark.createDataFrame([(path, [pattern])], "path string, p array<string>")
    compiled = globs.compile_patterns(F.col("p"))
    assert frame.select(globs.selects(F.col("path"), compiled)).first()[0] is matches


def test_unmatched_patterns_and_symlinks(spark, rows):
    table = files(spark, "src/a", links=("src/l2", "src/l1", "other"))
    task = tasks(spark, ["src/**", "!src/a", "docs/*", "!none", "src/l1"])
    assert rows(fp.unmatched_patterns(table, task), "pattern") == [("docs/*",), ("src/l1",)]
    assert rows(fp.symlink_matches(table, task), "path") == [("src/l1",)]


def test_outputs_never_count_as_inputs(spark, rows):
    task = tasks(spark, ["**"], ["dist/**", "!dist/keep"])
    selected = fp.select_files(files(spark, "a", "dist/b", "dist/keep"), task)
    assert rows(fp.exclude_outputs(selected, task), "path") == [("a",), ("dist/keep",)]


def test_environment(spark, rows):
    ambient = spark.createDataFrame(
        [("p", {"HOME": "/h", "CI": "1", "X": "ambient"})], "project_id string, environment map<string,string>"
    )
    named = tasks(spark, [], cache_env=["X", "HOME", "NOPE", "X"], env={"X": "task", "Y": "y"})
    assert rows(fp.select_environment(named, ambient), "variable", "value") == [
        ("HOME", "/h"), ("NOPE", "<unset>"), ("X", "task"),
    ]
    everything = tasks(spark, [], cache_env=["*"], env={"X": "task", "Y": "y"})
    assert rows(fp.select_environment(everything, ambient), "variable", "value") == [
        ("CI", "1"), ("HOME", "/h"), ("X", "task"), ("Y", "y"),
    ]


def digest(spark, items):
    frame = spark.createDataFrame(
        [("p", "t", *item) for item in items],
        "project_id string, task_id string, path string, size bigint, mode bigint, sha256 string",
    )
    return fp.input_digest(frame).first()["digest"]


def test_digest_sensitivity(spark):
    base = [("a", 1, 420, "x"), ("b", 2, 420, "y")]
    same = digest(spark, base)
    assert digest(spark, base[::-1]) == same
    for changed in (
        [("a", 1, 420, "z"), base[1]],
        [("a", 1, 493, "x"), base[1]],
        [("a", 3, 420, "x"), base[1]],
        [("ab", 1, 420, "x"), ("", 2, 420, "y")],
        base[:1],
    ):
        assert digest(spark, changed) != same


def keys(spark, own, pairs):
    table = spark.createDataFrame(
        [("p", t, i, d) for i, (t, d) in enumerate(pairs)],
        "project_id string, task_id string, dep_pos bigint, dep_id string",
    )
    nodes = spark.createDataFrame(
        [("p", t, o) for t, o in own.items()], "project_id string, task_id string, own string"
    )
    levels = graph.task_levels(table, nodes)
    return {r.task_id: r.key for r in fp.task_keys(nodes, table, levels).collect()}


def test_keys_chain_through_dependencies(spark):
    pairs = [("app", "lib"), ("lib", "base")]
    first = keys(spark, {"app": "1", "lib": "2", "base": "3", "x": "4"}, pairs)
    changed = keys(spark, {"app": "1", "lib": "2", "base": "changed", "x": "4"}, pairs)
    assert {t for t in first if first[t] != changed[t]} == {"app", "lib", "base"}


def test_caching_needs_all_dependencies_to_allow_it(spark, rows):
    table = spark.createDataFrame(
        [("p", "app", 0, "lib"), ("p", "lib", 0, "base"), ("p", "x", 0, "y")],
        "project_id string, task_id string, dep_pos bigint, dep_id string",
    )
    nodes = spark.createDataFrame(
        [("p", t, t != "base") for t in ("app", "lib", "base", "x", "y")],
        "project_id string, task_id string, cache boolean",
    )
    assert rows(fp.cacheable_tasks(nodes, table), "task_id", "cacheable") == [
        ("app", False), ("base", False), ("lib", False), ("x", True), ("y", True),
    ]


def test_cache_decisions(spark, rows):
    out = "array<struct<path:string,sha256:string>>"
    index = spark.createDataFrame(
        [
            ("ok", 3, "ok", True, True, [("a", "1")]),
            ("none", 3, "none", True, True, []),
            ("old", 2, "old", True, True, []),
            ("other", 3, "x", True, True, []),
            ("quiet", 3, "quiet", True, False, []),
            ("gone", 3, "gone", True, True, [("a", "1"), ("b", "2")]),
            ("changed", 3, "changed", True, True, [("a", "1")]),
        ],
        f"key string, version bigint, recorded_key string, has_stdout boolean, has_stderr boolean, outputs {out}",
    )
    stored = spark.createDataFrame(
        [("ok", "a", "1"), ("gone", "a", "1"), ("changed", "a", "9")], "key string, path string, sha256 string"
    )
    wanted = spark.createDataFrame(
        [(k,) for k in ("ok", "none", "old", "other", "quiet", "gone", "changed", "absent")], "key string"
    )
    assert rows(fp.cache_decisions(wanted, index, stored), "key", "decision", "reason") == [
        ("absent", "miss", "no entry"), ("changed", "miss", "output changed"),
        ("gone", "miss", "output missing"), ("none", "hit", "ok"), ("ok", "hit", "ok"),
        ("old", "miss", "other version"), ("other", "miss", "other key"),
        ("quiet", "miss", "output stream missing"),
    ]
    assert {r.decision for r in fp.cache_decisions(wanted, index, stored, "force").collect()} == {"miss"}
    assert {r.decision for r in fp.cache_decisions(wanted, index, stored, "no_cache").collect()} == {"skip"}
    with pytest.raises(ValueError):
        fp.cache_decisions(wanted, index, stored, "sometimes")


def test_first_writer_wins(spark, rows):
    index = spark.createDataFrame([("kept",)], "key string")
    new = spark.createDataFrame(
        [("kept", 1, "a"), ("new", 2, "b"), ("new", 1, "z"), ("new", 1, "c")],
        "key string, written_at bigint, writer string",
    )
    assert rows(fp.append_entries(index, new)) == [("new", 1, "c")]


def test_keyed_matching_equals_comparing_everything(spark, rows):
    names = ["a", "src", "x.md", ".txt", "b.c.txt", "Cargo.toml", "a*b"]
    paths = [*names, *[f"{d}/{n}" for d in ("src", "src/a", "docs/src/a", ".x") for n in names]]
    sources = ["**", "*", "src", "src/**", "**/x.md", "src/*/x.md", "*.txt", "**/*.txt", "s*/**", "src/a*b", "docs/**/a",
               "**/*.*", "src/**/**", "*/a/**", "a*b", "**.txt", ".x/.txt", "", "/", "src/"]
    tasks = spark.createDataFrame(
        [("p", f"t{k}", [s]) for k, s in enumerate(sources)]
        + [("p", "mixed", ["**", "!src/**", "src/a/**", "!**/*.txt"])],
        "project_id string, task_id string, inputs array<string>",
    )
    table = spark.createDataFrame([("p", path, False) for path in paths], "project_id string, path string, is_symlink boolean")
    compiled = tasks.select("task_id", globs.compile_patterns(F.col("inputs")).alias("c"))
    want = table.select("path").crossJoin(compiled).where(globs.selects(F.col("path"), F.col("c")))
    assert rows(fp.select_files(table, tasks), "path", "task_id") == rows(want, "path", "task_id")
