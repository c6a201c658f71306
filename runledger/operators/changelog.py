"""A corpus of changelogs.

A changelog is one text. It is parsed into an array of entries in its own row,
and validation, lookup, preparation and rendering all work inside that row, so
the whole family runs without a shuffle (joining requests aside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import text, versions
from runledger.functions.rows import explode_rows

# The words of the changelog form.
TITLE = "# Changelog"
ENTRY_MARK = "## "
UNRELEASED = "(unreleased)"
RELEASED = "Released: "
MERGE_SUBJECT = "Merge pull request #"
MERGE_FROM = " from "
NUMBER_PLACEHOLDER = "{number}"

_ENTRY_TYPE = (
    f"array<struct<entry_no:bigint,heading:string,version:{versions.VERSION_TYPE},body:string>>"
)


def _entry(section: Column, number: Column) -> Column:
    first_line = F.substring_index(section, "\n", 1)
    heading = F.regexp_replace(F.substr(first_line, F.lit(4)), "\r+\\z", "")
    body = F.substr(section, F.length(first_line) + 2)
    return F.struct(
        number.cast("bigint").alias("entry_no"),
        heading.alias("heading"),
        versions.parse_version(heading).alias("version"),
        body.alias("body"),
    )


def parse_changelogs(texts: DataFrame) -> DataFrame:
    """``file, text`` to ``file, has_title, preamble, entries``.

    An entry starts at a line that begins with ``## ``; what precedes the first
    one is the preamble. Headings are kept as written; ``version`` is null for
    anything but a strict version.
    """
    sections = F.split("text", "(?<=\n)(?=## )", -1)
    is_entry = lambda s: s.startswith(ENTRY_MARK)
    return texts.withColumn("_sections", sections).select(
        "file",
        F.col("text").startswith(TITLE).alias("has_title"),
        F.array_join(F.filter("_sections", lambda s: ~is_entry(s)), "").alias("preamble"),
        F.transform(F.filter("_sections", is_entry), _entry).cast(_ENTRY_TYPE).alias("entries"),
    )


def parse_entries(texts: DataFrame) -> DataFrame:
    """One row per entry: file, entry_no, heading, version, body."""
    return explode_rows(parse_changelogs(texts), ["file"], "entries", "e").select("file", "e.*")


def _is_release_line(line: Column) -> Column:
    return line.startswith(RELEASED) & text.is_date(F.substr(line, F.lit(len(RELEASED) + 1)))


def _violations() -> Column:
    """All rule violations of a parsed changelog, as an array.

    Reads ``_versioned``: number, heading, version and first text line of the
    entries that have a version.
    """

    def issue(number: Column | None, rule: str, detail: Column) -> Column:
        entry_no = F.lit(-1) if number is None else number
        return F.struct(
            entry_no.cast("bigint").alias("entry_no"),
            F.lit(rule).alias("rule"),
            detail.alias("detail"),
        )

    entries = F.col("entries")
    whole = F.array(
        F.when(~F.col("has_title"), issue(None, "title missing", F.lit(""))),
        F.when(F.size(entries) == 0, issue(None, "no entries", F.lit(""))),
    )
    unknown = F.transform(
        F.filter(entries, lambda e: e["version"].isNull() & (e["heading"] != UNRELEASED)),
        lambda e: issue(e["entry_no"], "unknown heading", e["heading"]),
    )
    versioned = F.col("_versioned")

    def first_line_issue(e: Column) -> Column:
        line = e["line"]
        return F.when(line.isNull(), issue(e["entry_no"], "entry is empty", e["heading"])).when(
            ~_is_release_line(line), issue(e["entry_no"], "release line", line)
        )

    def order_issue(e: Column, i: Column) -> Column:
        before = F.get(versioned, i - 1)
        return F.when(
            (i > 0) & (e["version"] >= before["version"]),
            issue(e["entry_no"], "not newest first", e["heading"]),
        )

    def unreleased_issue(e: Column, i: Column) -> Column:
        return F.when(i > 0, issue(e["entry_no"], "second unreleased", e["heading"])).when(
            e["entry_no"] > 0, issue(e["entry_no"], "unreleased below the top", e["heading"])
        )

    unreleased = F.filter(entries, lambda e: e["heading"] == UNRELEASED)
    return F.array_compact(
        F.concat(
            whole,
            unknown,
            F.transform(versioned, first_line_issue),
            F.transform(versioned, order_issue),
            F.transform(unreleased, unreleased_issue),
        )
    )


def validate_changelogs(parsed: DataFrame) -> DataFrame:
    """Every violation: file, entry_no (-1 for the file itself), rule, detail."""
    return explode_rows(_with_violations(parsed), ["file"], "violations", "v").select(
        "file", "v.*"
    )


def _with_violations(parsed: DataFrame) -> DataFrame:
    versioned = F.transform(
        F.filter("entries", lambda e: e["version"].isNotNull()),
        lambda e: F.struct(
            e["entry_no"].alias("entry_no"),
            e["heading"].alias("heading"),
            e["version"].alias("version"),
            text.first_text_line(e["body"]).alias("line"),
        ),
    )
    return (
        parsed.withColumn("_versioned", versioned)
        .withColumn("violations", _violations())
        .drop("_versioned")
    )


def _with_validity(parsed: DataFrame) -> DataFrame:
    return (
        _with_violations(parsed)
        .withColumn("is_valid", F.size("violations") == 0)
        .drop("violations")
    )


def _top() -> Column:
    return F.get("entries", F.lit(0))


def top_entries(parsed: DataFrame) -> DataFrame:
    """Newest entry and number of entries of each changelog that has any."""
    return parsed.where(F.size("entries") > 0).select(
        "file",
        _top()["heading"].alias("heading"),
        F.size("entries").cast("bigint").alias("entry_count"),
    )


def _next_version(top: Column) -> Column:
    version = top["version"]
    patch = version["patch"]
    following = F.struct(
        version["major"].alias("major"),
        version["minor"].alias("minor"),
        (patch + 1).cast("decimal(20,0)").alias("patch"),
    )
    return F.when(patch < versions.u64_max(), following)


def _next_error(top: Column) -> Column:
    return (
        F.when(top["heading"] == UNRELEASED, "the newest entry is unreleased")
        .when(top["version"].isNull(), "the newest entry has no version")
        .when(top["version"]["patch"] >= versions.u64_max(), "the version cannot be incremented")
    )


def next_versions(parsed: DataFrame) -> DataFrame:
    """Next patch version after the newest entry, or why there is none."""
    return parsed.where(F.size("entries") > 0).select(
        "file", _next_version(_top()).alias("version"), _next_error(_top()).alias("error")
    )


def request_heading(request: Column) -> Column:
    """Heading text a request stands for, or null if it is malformed."""
    bare = F.regexp_replace(text.trim(request), r"\Av", "")
    version = versions.parse_version(bare)
    return F.when(bare == "unreleased", UNRELEASED).when(
        version.isNotNull(), versions.format_version(version)
    )


def _entry_with(heading: Column) -> Column:
    return F.get(F.filter("entries", lambda e: e["heading"] == heading), F.lit(0))


def lookup_entries(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested entries: file, request, heading, body, error."""
    found = requests.join(parsed, "file", "left").withColumn(
        "wanted", request_heading(F.col("request"))
    ).withColumn("found", _entry_with(F.col("wanted")))
    error = (
        F.when(F.col("wanted").isNull(), "malformed request")
        .when(F.col("entries").isNull(), "unknown file")
        .when(F.col("found").isNull(), "entry not found")
    )
    return found.select(
        "file",
        "request",
        F.col("found.heading").alias("heading"),
        F.col("found.body").alias("body"),
        error.alias("error"),
    )


def prepare_entries(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """Add a new top entry, or give the unreleased one its version.

    ``requests``: file, request (null for the next patch version), date,
    bullets; one per file. Adds action (inserted or renamed) and error;
    ``entries`` is unchanged where there is an error.
    """
    top = _top()
    rows = requests.join(_with_validity(parsed), "file", "left")
    automatic = versions.format_version(_next_version(top))
    rows = rows.withColumn(
        "wanted",
        F.when(F.col("request").isNull(), automatic).otherwise(request_heading(F.col("request"))),
    )
    error = (
        F.when(F.col("request").isNotNull() & F.col("wanted").isNull(), "malformed request")
        .when(F.col("entries").isNull(), "unknown file")
        .when(~F.col("is_valid"), "invalid changelog")
        .when(F.col("request").isNull() & F.col("wanted").isNull(), _next_error(top))
        .when(~text.is_date("date"), "invalid date")
        .when(_entry_with(F.col("wanted")).isNotNull(), "entry already exists")
    )
    renames = (top["heading"] == UNRELEASED) & (F.col("wanted") != UNRELEASED)
    body = F.concat(
        F.lit(RELEASED),
        "date",
        F.lit("\n\n"),
        F.array_join(F.transform("bullets", lambda b: F.concat(b, F.lit("\n"))), ""),
    )

    def made(content: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(0).cast("bigint").alias("entry_no"),
                F.col("wanted").alias("heading"),
                versions.parse_version(F.col("wanted")).alias("version"),
                content.alias("body"),
            )
        ).cast(_ENTRY_TYPE)

    rest = F.slice("entries", 2, F.greatest(F.size("entries"), F.lit(1)))
    changed = F.when(renames, F.concat(made(top["body"]), rest)).otherwise(
        F.concat(made(body), F.col("entries"))
    )
    renumbered = F.transform(changed, lambda e, i: e.withField("entry_no", i.cast("bigint")))
    return rows.withColumn("error", error).select(
        "file",
        "has_title",
        "preamble",
        F.when(F.col("error").isNull(), renumbered).otherwise(F.col("entries"))
        .cast(_ENTRY_TYPE).alias("entries"),
        F.when(F.col("error").isNull(), F.when(renames, "renamed").otherwise("inserted"))
        .alias("action"),
        "error",
    )


def _substantive_body(body: Column) -> Column:
    trimmed = text.trim(body)
    lines = text.lines(trimmed)
    more = F.exists(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda l: ~text.is_blank(l))
    return F.when(
        (trimmed != "") & (~F.get(lines, F.lit(0)).startswith(RELEASED) | more), trimmed
    )


def release_notes(parsed: DataFrame, targets: DataFrame, newest_only: bool = True) -> DataFrame:
    """Notes text per target: file, notes, error.

    ``targets``: file, version, release_tag; either may be null. With
    ``newest_only`` the target must be the newest entry, which must not be
    unreleased; without it any entry named by ``version`` may be taken.
    """
    rows = targets.join(_with_validity(parsed), "file", "left")
    version = request_heading(F.col("version"))
    tag = request_heading(F.col("release_tag"))
    top = _top()["heading"]
    asked = F.coalesce(version, tag)
    wanted = F.coalesce(asked, top) if newest_only else asked
    rows = rows.withColumn("wanted", wanted).withColumn(
        "content", _substantive_body(_entry_with(F.col("wanted"))["body"])
    )
    malformed = (F.col("version").isNotNull() & version.isNull()) | (
        F.col("release_tag").isNotNull() & tag.isNull()
    )
    error = (
        F.when(malformed, "malformed request")
        .when(version != tag, "version and tag differ")
        .when(F.col("entries").isNull(), "unknown file")
        .when(~F.col("is_valid"), "invalid changelog")
    )
    if newest_only:
        error = error.when(top == UNRELEASED, "the newest entry is unreleased").when(
            F.col("wanted") != top, "not the newest entry"
        )
    error = error.when(
        _entry_with(F.col("wanted")).isNull(), "entry not found"
    ).when(F.col("content").isNull(), "entry has no content")
    notes = F.concat(
        F.lit("# "), "wanted", F.lit("\n\n## Changelog\n\n"), "content", F.lit("\n")
    )
    return rows.withColumn("error", error).select(
        "file", F.when(F.col("error").isNull(), notes).alias("notes"), "error"
    )


def render_changelogs(parsed: DataFrame) -> DataFrame:
    """The text of each changelog: file, text. Undoes :func:`parse_changelogs`."""
    entries = F.array_join(
        F.transform(
            "entries",
            lambda e: F.concat(F.lit(ENTRY_MARK), e["heading"], F.lit("\n"), e["body"]),
        ),
        "",
    )
    return parsed.select("file", F.concat("preamble", entries).alias("text"))


def merge_bullets(records: DataFrame, url_template: str | None = None) -> DataFrame:
    """Adds ``bullet``: a list item for each merge record (subject, body)."""
    rest = F.when(
        F.col("_subject").startswith(MERGE_SUBJECT),
        F.substr("_subject", F.lit(len(MERGE_SUBJECT) + 1)),
    )
    at = F.instr("_rest", MERGE_FROM)
    digits = F.when(at > 0, F.substr("_rest", F.lit(1), at - 1))
    value = F.when(digits.rlike(r"\A\+?[0-9]+\z"), digits.try_cast("decimal(20,0)"))
    last_part = F.substring_index(F.substr("_rest", at + len(MERGE_FROM)), "/", -1)
    first_line = text.trim(text.first_text_line("body"))
    is_merge = F.col("_number").isNotNull()
    number = F.col("_number").cast("string")
    summary = F.coalesce(first_line, F.when(is_merge, last_part), F.col("_subject"))
    if url_template is None:
        reference = F.concat(F.lit("#"), number)
    else:
        link = F.replace(F.lit(url_template), F.lit(NUMBER_PLACEHOLDER), number)
        reference = F.concat(F.lit("[#"), number, F.lit("]("), link, F.lit(")"))
    bullet = F.when(
        is_merge, F.concat(F.lit("- "), reference, F.lit("\n\n  "), summary)
    ).otherwise(F.concat(F.lit("- "), summary))
    return (
        records.withColumn("_subject", text.trim("subject"))
        .withColumn("_rest", rest)
        .withColumn("_value", value)
        .withColumn("_number", F.when(F.col("_value") <= versions.u64_max(), F.col("_value")))
        .withColumn("bullet", bullet)
        .drop("_subject", "_rest", "_value", "_number")
    )


def truncate_text(rows: DataFrame, limit: int, column: str = "data") -> DataFrame:
    """Adds ``text``: at most ``limit`` bytes, trimmed, marked if cut."""
    kept = F.make_valid_utf8(F.substr(column, F.lit(1), F.lit(limit)).cast("string"))
    mark = F.when(F.length(column) > limit, "…").otherwise("")
    return rows.withColumn("text", F.concat(text.trim(kept), mark))


def lint_refs(requests: DataFrame) -> DataFrame:
    """Unsafe revision names and address templates: request_id, field, value, reason.

    ``requests``: request_id, from_ref, to_ref, url_template (may be null).
    """
    def ref_reason(value: Column) -> Column:
        return (
            F.when(value == "", "empty")
            .when(value.startswith("-"), "starts with a dash")
            .when(value.rlike(r"(?U)[\s\x00]"), "white space or NUL")
        )

    checks = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), ref_reason(F.col(f)).alias("reason"))
            for f in ("from_ref", "to_ref")
        ],
        F.struct(
            F.lit("url_template").alias("field"),
            F.col("url_template").alias("value"),
            F.when(
                ~F.col("url_template").contains(NUMBER_PLACEHOLDER), "no number placeholder"
            ).alias("reason"),
        ),
    )
    return (
        explode_rows(requests, ["request_id"], checks, "c")
        .select("request_id", "c.*")
        .where(F.col("reason").isNotNull())
    )
