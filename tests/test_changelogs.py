"""Changelog parsing, validation, preparation and notes."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import changelogs as checks
from checks.compare import compare
from runledger.functions import text, versions
from runledger.operators import changelog as cl
from runledger.sources import blocks, published
from runledger.sources import changelogs as src

GOOD = (
    "# Changelog\n\nIntro.\n\n## 1.2.3\n\nReleased: 2026-09-11\n\n- newest\n\n"
    "## 1.2.2\n\nReleased: 2026-09-10\n\n- older\n"
)
OPEN = "# Changelog\n\n## (unreleased)\n\nReleased: 2026-09-12\n\n- open\n\n" + GOOD.split("Intro.\n\n")[1]


def parsed(spark, *texts):
    frame = spark.createDataFrame(
        [(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string"
    )
    return cl.parse_changelogs(frame)


@pytest.mark.parametrize("content", [
    GOOD, OPEN, "# Changelog", "", "## 1.0.0\nx", "# Changelog\n## 1.0.0", "no title\n\n## x\n## y\n",
    GOOD.replace("\n", "\r\n").replace("## 1.2.3\r", "## 1.2.3").replace("## 1.2.2\r", "## 1.2.2"),
    "# Changelog\n ## not an entry\n##not\n## 1.0.0\n\n## trailing",
])
def test_render_undoes_parse(spark, content):
    got = cl.render_changelogs(parsed(spark, content)).first()["text"]
    assert got == (content if not content.endswith(("1.0.0", "trailing")) else content + "\n")


def violations(spark, rows, content):
    return rows(cl.validate_changelogs(parsed(spark, content)), "entry_no", "rule")


@pytest.mark.parametrize("content, want", [
    (GOOD, []),
    (OPEN, []),
    (GOOD.replace("\n", "\r\n"), []),
    ("Changes\n" + GOOD, [(-1, "title missing")]),
    ("# Changelog\n", [(-1, "no entries")]),
    (GOOD.replace("1.2.3", "v1.2.3"), [(0, "unknown heading")]),
    (GOOD.replace("1.2.3", "01.2.3"), [(0, "unknown heading")]),
    (GOOD.replace("1.2.3", "1.2"), [(0, "unknown heading")]),
    (GOOD.replace("1.2.3", "1.2.2"), [(1, "not newest first")]),
    (GOOD.replace("1.2.2", "1.10.0"), [(1, "not newest first")]),
    (GOOD.replace("2026-09-11", "2026-9-11"), [(0, "release line")]),
    (GOOD.replace("Released: 2026-09-10\n\n- older\n", ""), [(1, "entry is empty")]),
    (GOOD.replace("Released: 2026-09-10", "released: 2026-09-10"), [(1, "release line")]),
    (GOOD.replace("## 1.2.2", "## (unreleased)"), [(1, "unreleased below the top")]),
    (OPEN.replace("## 1.2.2", "## (unreleased)"), [(2, "second unreleased")]),
    (GOOD.replace("1.2.3", "odd") + "\n## 1.2.4\n\nReleased: 2026-01-01\n",
     [(0, "unknown heading"), (2, "not newest first")]),
])
def test_validation(spark, rows, content, want):
    assert violations(spark, rows, content) == want


def test_top_and_next(spark, rows):
    largest = GOOD.replace("1.2.3", "1.2.18446744073709551615")
    too_large = GOOD.replace("1.2.3", "1.2.18446744073709551616")
    table = parsed(spark, GOOD, OPEN, largest, too_large)
    assert rows(cl.top_entries(table)) == [
        ("f0", "1.2.3", 2), ("f1", "(unreleased)", 3), ("f2", "1.2.18446744073709551615", 2),
        ("f3", "1.2.18446744073709551616", 2),
    ]
    got = cl.next_versions(table).select("file", versions.format_version(F.col("version")), "error")
    assert rows(got) == [
        ("f0", "1.2.4", None), ("f1", None, "the newest entry is unreleased"),
        ("f2", None, "the version cannot be incremented"),
        ("f3", None, "the newest entry has no version"),
    ]


@pytest.mark.parametrize("value, valid", [
    ("2028-02-29", True), ("2027-02-29", False), ("2027-06-31", False), ("2027-5-07", False),
    ("2000-02-29", True), ("1900-02-29", False), ("2027-13-01", False), ("2027-00-10", False),
    ("2027-05-07\n", False), (" 2027-05-0", False), ("２027-05-07", False), ("", False),
])
def test_dates(spark, value, valid):
    frame = spark.createDataFrame([(value,)], "d string")
    assert frame.select(text.is_date("d")).first()[0] is valid


def test_lookup(spark, rows):
    requests = spark.createDataFrame(
        [("f0", r) for r in (" v1.2.2\n", "1.2.3", "unreleased", "vunreleased", "vv1.2.3", "9.9.9")],
        "file string, request string",
    )
    got = rows(cl.lookup_entries(parsed(spark, OPEN), requests), "request", "heading", "error")
    assert got == [
        (" v1.2.2\n", "1.2.2", None), ("1.2.3", "1.2.3", None), ("9.9.9", None, "entry not found"),
        ("unreleased", "(unreleased)", None), ("vunreleased", "(unreleased)", None),
        ("vv1.2.3", None, "malformed request"),
    ]


def prepare(spark, content, request, date="2026-10-01", bullets=("- a", "- b")):
    requests = spark.createDataFrame(
        [("f0", request, date, list(bullets))], "file string, request string, date string, bullets array<string>"
    )
    got = cl.prepare_entries(parsed(spark, content), requests)
    first = got.first()
    return first.action, first.error, cl.render_changelogs(got).first()["text"]


def test_prepare(spark):
    action, error, rendered = prepare(spark, GOOD, None)
    assert (action, error) == ("inserted", None)
    assert rendered == GOOD.replace(
        "## 1.2.3", "## 1.2.4\nReleased: 2026-10-01\n\n- a\n- b\n## 1.2.3"
    )
    action, error, rendered = prepare(spark, OPEN, "v2.0.0")
    assert (action, error) == ("renamed", None)
    assert rendered == OPEN.replace("(unreleased)", "2.0.0")
    assert prepare(spark, GOOD, "unreleased")[:2] == ("inserted", None)
    for content, request, date, want in [
        (OPEN, None, "2026-10-01", "the newest entry is unreleased"),
        (GOOD, "1.2.2", "2026-10-01", "entry already exists"),
        (OPEN, "unreleased", "2026-10-01", "entry already exists"),
        (GOOD, "2.0.0", "2026-02-30", "invalid date"),
        (GOOD, "2.x", "2026-10-01", "malformed request"),
        ("x" + GOOD, "2.0.0", "2026-10-01", "invalid changelog"),
    ]:
        action, error, rendered = prepare(spark, content, request, date)
        assert (action, error, rendered) == (None, want, content)


@pytest.mark.parametrize("content, version, tag, want", [
    (GOOD, None, None, None),
    (GOOD, "1.2.3", "v1.2.3", None),
    (GOOD, None, "v1.2.3", None),
    (GOOD, "1.2.2", None, "not the newest entry"),
    (GOOD, "1.2.3", "v1.2.2", "version and tag differ"),
    (GOOD, "x", None, "malformed request"),
    (OPEN, None, None, "the newest entry is unreleased"),
    (GOOD.replace("\n- newest\n", ""), None, None, "entry has no content"),
    ("x" + GOOD, None, None, "invalid changelog"),
])
def test_release_notes(spark, content, version, tag, want):
    targets = spark.createDataFrame(
        [("f0", version, tag)], "file string, version string, release_tag string"
    )
    got = cl.release_notes(parsed(spark, content), targets).first()
    assert got.error == want
    if want is None:
        assert got.notes == "# 1.2.3\n\n## Changelog\n\nReleased: 2026-09-11\n\n- newest\n"


def test_historical_notes(spark):
    targets = spark.createDataFrame([("f0", "1.2.2", None)], "file string, version string, release_tag string")
    got = cl.release_notes(parsed(spark, OPEN), targets, newest_only=False).first()
    assert got.notes == "# 1.2.2\n\n## Changelog\n\nReleased: 2026-09-10\n\n- older\n"


def test_merge_bullets(spark):
    log = (
        "Merge pull request #12 from org/topic\x1f\n  Add thing \nmore\x1e\n"
        "Merge pull request #0013 from org/fix/deep\x1f\x1e\n"
        "Merge branch 'x'\x1f\x1e\n\x1e"
        "Merge pull request #abc from org/y\x1f \n\x1e"
        "Merge pull request #7 from plain\x1e"
        "Merge pull request #18446744073709551616 from org/z\x1f\x1e"
    )
    texts = spark.createDataFrame([("f", log)], "file string, text string")
    records, errors = src.parse_merge_logs(texts)
    assert errors.count() == 0
    linked = cl.merge_bullets(records, "https://h/{number}/{number}").orderBy("record_no")
    assert [r.bullet for r in linked.collect()] == [
        "- [#12](https://h/12/12)\n\n  Add thing",
        "- [#13](https://h/13/13)\n\n  deep",
        "- Merge branch 'x'",
        "- Merge pull request #abc from org/y",
        "- [#7](https://h/7/7)\n\n  plain",
        "- Merge pull request #18446744073709551616 from org/z",
    ]
    plain = cl.merge_bullets(records).orderBy("record_no").first()["bullet"]
    assert plain == "- #12\n\n  Add thing"


def test_oversized_merge_log_is_kept_and_reported(spark, rows):
    big = "x" * (src.MERGE_LOG_BYTES + 1)
    records, errors = src.parse_merge_logs(spark.createDataFrame([("f", big), ("g", "y")], "file string, text string"))
    assert [(r.file, r.record_no, len(r.subject)) for r in records.orderBy("file").collect()] == [
        ("f", 0, src.MERGE_LOG_BYTES + 1), ("g", 0, 1)
    ]
    assert rows(errors) == [("f", "merge log too large")]


@pytest.mark.parametrize("data, limit, want", [
    (b"  short \n", 20, "short"),
    (b"abcdef", 3, "abc…"),
    ("éé".encode(), 3, "é�…"),
    (b"ab\xffcd", 10, "ab�cd"),
    (b"", 3, ""),
])
def test_truncation(spark, data, limit, want):
    frame = spark.createDataFrame([(bytearray(data),)], "data binary")
    assert cl.truncate_text(frame, limit).first()["text"] == want


def test_ref_lint(spark, rows):
    frame = spark.createDataFrame(
        [(1, "v1", "v2", None), (2, "", "-x", "https://h"), (3, "a b", "a\0", "https://h/{number}")],
        "request_id bigint, from_ref string, to_ref string, url_template string",
    )
    assert rows(cl.lint_refs(frame), "request_id", "field", "reason") == [
        (2, "from_ref", "empty"), (2, "to_ref", "starts with a dash"),
        (2, "url_template", "no number placeholder"), (3, "from_ref", "white space or NUL"),
        (3, "to_ref", "white space or NUL"),
    ]


def test_files_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    texts = spark.createDataFrame([("a", GOOD), ("b", OPEN)], "file string, text string")
    src.write_changelogs(texts, path)
    read = src.read_changelogs(spark, path)
    assert rows(read, "file", "text") == [("a", GOOD), ("b", OPEN)]
    lines = src.changelog_lines(read.where("file = 'a'")).orderBy("line_no")
    assert "".join(r.line for r in lines.collect()) == GOOD


def test_files_change_together(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda *pairs: spark.createDataFrame(pairs, "file string, text string")
    assert published.current_version(spark, path) is None
    src.write_changelogs(frame(("a", "one\n"), ("b/ü %", "no end"), ("c", "\r\n\n"), ("d", "")), path)
    first = [("a", "one\n"), ("b/ü %", "no end"), ("c", "\r\n\n"), ("d", "")]
    assert rows(src.read_changelogs(spark, path), "file", "text") == first
    # A write that fails before its list is complete changes nothing.
    failing = frame(("a", "new"), ("z", "new")).withColumn("text", F.when(F.col("file") == "z", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        src.write_changelogs(failing, path)
    assert rows(src.read_changelogs(spark, path), "file", "text") == first
    # An empty text replaces, a null takes away, texts read from here can be written here.
    src.write_changelogs(frame(("a", ""), ("c", None), ("d", "now\n"), ("e", None)), path)
    src.write_changelogs(src.read_changelogs(spark, path).where("file = 'd'").withColumn("text", F.lit("later")), path)
    last = [("a", ""), ("b/ü %", "no end"), ("d", "later")]
    assert rows(src.read_changelogs(spark, path), "file", "text") == last
    published.vacuum(spark, path)
    assert rows(src.read_changelogs(spark, path), "file", "text") == last
    assert sorted(os.listdir(f"{path}/texts")) == ["version=0", "version=2"] and os.listdir(f"{path}/lists") == ["version=2"]
    src.write_changelogs(frame(("b/ü %", None), ("d", None)), path)
    assert rows(src.read_changelogs(spark, path), "file", "text") == [("a", "")]


def test_notes_are_written(spark, rows, tmp_path):
    notes = spark.createDataFrame([("a", "# 1\n", None), ("b", None, "unknown file")], "file string, notes string, error string")
    src.write_notes(notes, str(tmp_path / "notes"))
    assert rows(src.read_changelogs(spark, str(tmp_path / "notes")), "file", "text") == [("a", "# 1\n")]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_are_numbered_across_blocks(spark, rows, tmp_path, small_blocks):
    rng = random.Random(2)
    (tmp_path / "logs").mkdir()
    texts = {
        f"{k}.log": "".join(rng.choice(["", "\n", "subject\x1fbody\x1e", "a\rb\n\x1e", "\x1e", "long " * 30]) for _ in range(n))
        for k, n in enumerate([0, 1, 60, 300])
    }
    for name, content in texts.items():
        (tmp_path / "logs" / name).write_text(content, newline="")
    path = str(tmp_path / "logs")
    raw = blocks.numbered_records(spark, path, src.RECORD_SEPARATOR)
    assert raw.rdd.getNumPartitions() > 3
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    lines = blocks.numbered_lines(spark, path).select(name, "line_no", "line")
    want = []
    for file, content in texts.items():
        pieces = re.split("\r?\n", content)
        want += [(file, i + 1, p) for i, p in enumerate(pieces[:-1] if pieces[-1] == "" else pieces)]
    assert rows(lines) == sorted(want, key=repr)
    records, large = src.read_merge_log(spark, path, 500)
    frame = spark.createDataFrame(list(texts.items()), "file string, text string")
    whole, _ = src.parse_merge_logs(frame)
    assert rows(records.withColumn("file", name)) == rows(whole)
    assert rows(large.select(name)) == sorted((f,) for f, c in texts.items() if len(c) > 500)


def test_many_texts_are_stored_in_few_files(spark, tmp_path):
    path = str(tmp_path / "many")
    src.write_changelogs(spark.range(3000).selectExpr("concat('a/', id) AS file", "concat('text ', id) AS text"), path)
    stored = [n for _, _, names in os.walk(f"{path}/texts") for n in names if n.startswith("part-")]
    assert len(stored) <= 16
    assert src.read_changelogs(spark, path).where("text = concat('text ', split(file, '/')[1])").count() == 3000


def test_merge_logs_of_one_table(spark, rows, tmp_path):
    path = str(tmp_path / "logs")
    texts = spark.createDataFrame(
        [("a/ü", "one\x1fbody\x1e\n\x1e\ntwo"), ("b", ""), ("c", "\x1e long\r\n" * 90)], "file string, text string"
    )
    src.write_merge_logs(texts, path)
    read, parsed = src.read_merge_log(spark, path, 500), src.parse_merge_logs(texts, 500)
    assert [rows(r) for r in read] == [rows(p) for p in parsed] and len(rows(read[1])) == 1


def test_merge_log_check_at_its_bound_and_with_missing_orders(spark, tmp_path):
    # Logs of one order, of 11,448 to 11,450 bytes before their line end; then logs that miss some of their orders.
    alone = [(1792 * (n + 1), "P", "x" * (checks.LARGE_LOG - 13 + n)) for n in range(3)]
    some = [(k, "FOP"[k % 3], "1-URGENT") for k in (*range(8000, 8320), *range(9001, 9400, 3))]
    orders = spark.createDataFrame(alone + some, "o_orderkey bigint, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    ok, message = compare(spark, duck, str(tmp_path), "s8", checks.s8_merge_log, checks.ORACLE["s8_merge_log"])
    assert ok, message
    assert duck.execute(f"SELECT count(*) FROM ({checks.ORACLE['s8_merge_log']}) WHERE record_no = -1").fetchone() == (1,)
