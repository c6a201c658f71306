"""Release inventories, their reports and their files."""

import hashlib
import json

from pyspark.sql import functions as F

from runledger.operators import release
from runledger.plans.release_report import release_report
from runledger.sources import releases as src

FILE = "release string, name string, sha256 string, size bigint, kind string"
IDENTITY = (
    "release string, repository string, release_tag string, source_commit string, "
    "tag_object string, workflow_run string"
)


def files(spark, *items):
    return spark.createDataFrame([("r", n, s, z, k) for n, s, z, k in items], FILE)


def test_inventory_head_and_round_trip(spark, rows, tmp_path):
    table = files(spark, ("b", "2" * 64, 2, "file"), ("a/x", "1" * 64, 1, "file"),
                  ("SHA256SUMS", "3" * 64, 3, "file"), ("BUILD-METADATA.json", "4" * 64, 4, "file"))
    identity = spark.createDataFrame(
        [("r", "o/p", "v1", "", None, None), ("empty", "o/q", None, None, None, None)], IDENTITY
    )
    heads, artifacts, empty = release.build_inventory(table, identity)
    assert json.loads(heads.first()["head"]) == {
        "manifest_version": 1, "repository": "o/p", "release_tag": "v1"
    }
    assert rows(empty, "release") == [("empty",)]
    path = str(tmp_path / "out")
    src.write_release_outputs(heads, artifacts, path)
    folder = tmp_path / "out" / "document=metadata" / "release=r"
    document = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert [a["name"] for a in document["artifacts"]] == ["a/x", "b"]
    assert document["artifacts"][0] == {"name": "a/x", "sha256": "1" * 64, "size": 1}
    entries, errors = src.read_checksums(spark, f"{path}/document=checksums", by_folder=True)
    assert rows(entries, "name", "sha256") == [("a/x", "1" * 64), ("b", "2" * 64)]
    assert errors.count() == 0
    told, items, broken = src.read_release_metadata(spark, path)
    assert rows(told, "release", "manifest_version", "repository", "release_tag", "tag_object") == [("r", 1, "o/p", "v1", None)]
    assert rows(items) == [("r", "a/x", "1" * 64, 1), ("r", "b", "2" * 64, 2)] and broken.count() == 0
    [last] = [p for p in folder.glob("part-*") if "]}" in p.read_text()]
    last.write_text(last.read_text().replace("]}", ""))
    folder.joinpath(f".{last.name}.crc").unlink(missing_ok=True)
    assert rows(src.read_release_metadata(spark, path)[2], "release") == [("r",)]


def test_checksum_lines(spark, rows):
    good = "A" * 64
    lines = [f"{good}  ok", "", f"{good} one-space", f"abc  x", f"{good}  ../x", f"{good}  *star",
             f"{good}  ok", f"{good}  /abs", f"{good}  ", f"{good}   lead"]
    texts = spark.createDataFrame([("f", "\r\n".join(lines)), ("none", "\n")], "file string, text string")
    entries, errors = src.parse_checksums(texts)
    assert rows(entries) == [("f", " lead", "a" * 64), ("f", "ok", "a" * 64), ("f", "star", "a" * 64)]
    assert rows(errors) == sorted([
        ("f", 3, "expected digest and name"), ("f", 4, "invalid digest"), ("f", 5, "invalid name"),
        ("f", 7, "duplicate name"), ("f", 8, "invalid name"), ("f", 9, "invalid name"),
        ("none", 0, "no artifacts"),
    ], key=repr)


def test_lists_of_many_parts_are_one(spark, rows, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    folder = tmp_path / "document=checksums" / "release=r"
    folder.mkdir(parents=True)
    digest = "ab" * 32
    lines = [f"{digest}  f{k % 29}" if k % 7 else "" for k in range(40)]
    (folder / "part-0").write_text("".join(f"{x}\r\n" for x in lines[:25]))
    (folder / "part-1").write_text("\n".join(lines[25:]))
    (folder / "part-2").write_text("")
    other = tmp_path / "document=checksums" / "release=none"
    other.mkdir()
    (other / "part-0").write_text("\n  \n")
    (tmp_path / "names").mkdir()
    (tmp_path / "names" / "list").write_text("\n".join([*[f"n{k}" for k in range(90)], " n5 ", "/n6"]))
    try:
        entries, errors = src.read_checksums(spark, str(tmp_path / "document=checksums"), by_folder=True)
        names, bad = src.read_expected_names(spark, str(tmp_path / "names"))
        assert sorted(r.name for r in entries.collect()) == sorted({x.split("  ")[1] for x in lines if x})
        told = errors.select(F.regexp_extract("file", "release=(.*)", 1), "line_no", "error")
        seen, want = set(), [("none", 0, "no artifacts")]
        for k, x in enumerate(lines):
            if x and x in seen:
                want.append(("r", k + 1, "duplicate name"))
            seen.add(x)
        assert rows(told) == sorted(want, key=repr)
        assert names.count() == 90
        assert rows(bad, "line_no", "error") == [(91, "duplicate name"), (92, "invalid name")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_expected_names(spark, rows):
    texts = spark.createDataFrame([("f", " a \n\nb/..\n/c\na\nd..e\n")], "file string, text string")
    names, errors = src.parse_expected_names(texts)
    assert rows(names, "name") == [("a",), ("d..e",)]
    assert rows(errors, "line_no", "error") == [(3, "invalid name"), (4, "invalid name"), (5, "duplicate name")]


def test_file_inventory(spark, rows, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "SHA256SUMS").write_text("x")
    (tmp_path / "sub" / "SHA256SUMS").write_text("y")
    got = rows(src.read_file_inventory(spark, str(tmp_path)), "path", "size", "sha256")
    digest = lambda data: hashlib.sha256(data).hexdigest()
    assert got == [
        ("a.txt", 5, digest(b"hello")),
        ("sub/SHA256SUMS", 1, digest(b"y")),
        ("sub/b.bin", 2, digest(b"\x00\xff")),
    ]


def test_verification_reports_every_difference(spark, rows):
    actual = files(spark, ("same", "1", 1, "file"), ("edited", "x", 9, "file"), ("extra", "3", 3, "file"))
    recorded = spark.createDataFrame(
        [("r", "same", "1", 1), ("edited".replace("edited", "r"), "edited", "2", 2), ("r", "lost", "4", 4)],
        "release string, name string, sha256 string, size bigint",
    )
    listed = spark.createDataFrame(
        [("r", "same", "1"), ("r", "edited", "0"), ("r", "ghost", "5")],
        "release string, name string, sha256 string",
    )
    heads = spark.createDataFrame(
        [("r", 2, "o/p", "v1", None, None, None)],
        "release string, manifest_version bigint, repository string, release_tag string, "
        "source_commit string, tag_object string, workflow_run string",
    )
    assert rows(release.verify_inventory(heads, recorded, actual, listed), "name", "reason") == [
        ("", "unsupported manifest version 2"), ("edited", "checksum differs"),
        ("edited", "digest differs"), ("edited", "size differs"), ("extra", "not in manifest"),
        ("ghost", "checksum without artifact"), ("lost", "file missing"),
        ("lost", "not in checksum list"),
    ]
    expected = spark.createDataFrame([("r", "o/p", "v2", "", None, "77")], IDENTITY)
    assert rows(release.check_identity(heads, expected), "field", "actual") == [
        ("release_tag", "v1"), ("workflow_run", None),
    ]
    report = release_report(heads, recorded, actual, listed, expected)
    assert rows(report) == [("r", 10, False)]


def test_checksum_verification(spark, rows):
    actual = files(spark, ("ok", "1", 1, "file"), ("bad", "x", 1, "file"), ("link", "1", 1, "symlink"))
    listed = spark.createDataFrame(
        [("r", n, "1") for n in ("ok", "bad", "link", "gone")], "release string, name string, sha256 string"
    )
    assert rows(release.verify_checksums(listed, actual), "name", "reason") == [
        ("bad", "checksum mismatch"), ("gone", "missing"), ("link", "not a regular file"), ("ok", "ok"),
    ]


def test_source_check(spark, rows):
    checkouts = spark.createDataFrame([("a", "c1")], "repository string, commit string")
    tags = spark.createDataFrame([("a", "v1", "c1"), ("a", "v2", "c2")], "repository string, tag string, commit string")
    wanted = spark.createDataFrame(
        [("a", "v1", "c1"), ("a", "v1", "c9"), ("a", "v2", "c1"), ("a", "", "c1"), ("a", "-v", "c1"),
         ("a", "v 1", "c1"), ("a", "v1", "c 1"), ("a", "v3", "c1"), ("b", "v1", "c1")],
        "repository string, tag string, commit string",
    )
    got = rows(release.check_source(checkouts, tags, wanted), "repository", "tag", "commit", "reason")
    assert got == sorted([
        ("a", "v1", "c1", "ok"), ("a", "v1", "c9", "source does not match"),
        ("a", "v2", "c1", "source does not match"), ("a", "", "c1", "tag and commit must not be empty"),
        ("a", "-v", "c1", "unsafe tag"), ("a", "v 1", "c1", "unsafe tag"),
        ("a", "v1", "c 1", "unsafe commit"), ("a", "v3", "c1", "unknown tag"),
        ("b", "v1", "c1", "no checkout"),
    ], key=repr)


def test_artifact_names(spark, rows):
    table = spark.createDataFrame(
        [("r", bytearray(n), k) for n, k in [
            (b"ok/a", "file"), (b"l", "symlink"), (b"s", "socket"), (b"a\nb", "file"),
            (b"\xff", "file"), (b"../x", "file"), (b"./x", "file"), (b"/x", "file")]],
        "release string, raw_name binary, kind string",
    )
    assert rows(release.lint_artifact_names(table), "name", "reason") == [
        ("../x", "not a normal relative path"), ("./x", "not a normal relative path"),
        ("/x", "not a normal relative path"), ("a\nb", "newline in name"), ("l", "symlink"),
        ("s", "unsupported file type"), ("�", "not valid UTF-8"),
    ]


def test_a_large_list_moves_lines_and_no_texts(spark):
    from checks.releases import _large_list

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    lines = _large_list(docs)
    plan = lines._jdf.queryExecution().optimizedPlan()
    moved = [line for line in plan.toString().splitlines() if "RepartitionByExpression" in line or "sha2" in line]
    # The digest is below the exchange.
    assert len(moved) == 2 and "RepartitionByExpression" in moved[0]
    assert [r.value for r in lines.collect()][31] == "no digest" and lines.count() == 100


def test_many_releases_are_rows_of_few_files(spark, rows, tmp_path):
    names = [f"r%2F/{k} é" for k in range(300)]
    table = spark.createDataFrame(
        [(r, n, f"{k:064x}", k, "file") for k, r in enumerate(names) for n in ("b", "a/x", "c,d")], FILE
    )
    identity = spark.createDataFrame([(r, "o/p", "v1", "", None, None) for r in names], IDENTITY)
    heads, artifacts, _ = release.build_inventory(table, identity)
    path = str(tmp_path / "table")
    src.write_release_table(heads, artifacts, path)
    # There were two folders for each release before.
    assert len(list((tmp_path / "table").rglob("part-*"))) <= 2 * 5
    lines = src.read_release_lines(spark, path, "metadata").where(F.col("release") == names[7]).orderBy("part", "name")
    document = json.loads("".join(r.line for r in lines.collect()))
    assert [a["name"] for a in document["artifacts"]] == ["a/x", "b", "c,d"]
    want = sorted([(r.release, r.name, r.sha256) for r in artifacts.collect()], key=repr)
    entries, errors = src.read_checksum_table(spark, path)
    assert rows(entries) == want and errors.count() == 0
    told, items, broken = src.read_metadata_table(spark, path)
    assert rows(told, "release", "repository", "release_tag") == sorted([(r, "o/p", "v1") for r in names], key=repr)
    assert rows(items, "release", "name", "sha256") == want and broken.count() == 0


def test_lines_of_a_release_table_are_numbered_across_its_files(spark, rows, tmp_path):
    (tmp_path / "t").mkdir()
    digest, names = "ab" * 32, [f"f{k // 2:02}" for k in range(40)]
    stored = [("r", 1, f"{k:02}", f"{digest}  {n}" if k % 7 else "", k // 9) for k, n in enumerate(names)]
    columns = "release string, part int, name string, line string, task bigint"
    spark.createDataFrame([*stored, ("none", 1, "x", " ", 2)], columns).repartition(5).write.parquet(
        str(tmp_path / "t" / "document=checksums")
    )
    entries, errors = src.read_checksum_table(spark, str(tmp_path / "t"))
    seen, want = set(), [("none", 0, "no artifacts")]
    for k, n in enumerate(names):
        if k % 7 and n in seen:
            want.append(("r", k + 1, "duplicate name"))
        if k % 7:
            seen.add(n)
    assert rows(errors) == sorted(want, key=repr)
    assert rows(entries, "name") == sorted([(n,) for n in seen], key=repr)
