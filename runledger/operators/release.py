"""Release inventories: building and reconciling them.

Reports list every difference. All comparisons are joins on release and name,
which spread evenly however large one release is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import text
from runledger.functions.rows import explode_rows

_ITEM = ["release", "name"]
_METADATA = [schemas.RELEASE_METADATA_FILE, schemas.RELEASE_CHECKSUM_FILE]


def build_inventory(
    files: DataFrame, identity: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Release heads, their artifacts, and releases without any artifact.

    ``files``: release, name, sha256, size. ``identity``: release and the five
    identity fields. The two metadata files do not count. Heads carry the
    identity as JSON with absent fields left out; artifacts stay rows, to be
    sorted by name, because a release may hold any number of them.
    """
    artifacts = files.where(~F.col("name").isin(_METADATA)).select(*_ITEM, "sha256", "size")
    totals = artifacts.groupBy("release").agg(
        F.count("*").alias("artifact_count"), F.sum("size").alias("total_size")
    )
    fields = [F.nullif(F.col(f), F.lit("")).alias(f) for f in schemas.IDENTITY_FIELDS]
    known = identity.select("release", *fields)
    # A release whose identity is not known gets a head without the fields.
    described = totals.join(known, "release", "left")
    version = F.lit(schemas.RELEASE_MANIFEST_VERSION).alias("manifest_version")
    heads = described.select(
        "release",
        version,
        *schemas.IDENTITY_FIELDS,
        "artifact_count",
        "total_size",
        F.to_json(F.struct(version, *schemas.IDENTITY_FIELDS)).alias("head"),
    )
    empty = known.join(totals.select("release"), "release", "left_anti").select(
        "release", F.lit("no release artifacts").alias("reason")
    )
    return heads, artifacts, empty


def verify_checksums(checksums: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each listed name is a regular file with the listed digest.

    ``files``: release, name, sha256, kind (file, symlink, directory, other).
    """
    actual = files.select(*_ITEM, F.col("sha256").alias("actual"), "kind")
    reason = (
        F.when(F.col("kind").isNull(), "missing")
        .when(F.col("kind") != "file", "not a regular file")
        .when(F.col("actual") != F.col("sha256"), "checksum mismatch")
        .otherwise("ok")
    )
    return checksums.select(*_ITEM, "sha256").join(actual, _ITEM, "left").select(
        *_ITEM, "sha256", "actual", reason.alias("reason")
    )


def verify_inventory(
    releases: DataFrame, artifacts: DataFrame, files: DataFrame, checksums: DataFrame
) -> DataFrame:
    """Differences between manifest, folder and checksum list: release, name, reason.

    ``releases``: release, manifest_version. ``artifacts``: release, name,
    sha256, size as the manifest has them.
    """
    recorded = artifacts.select(
        *_ITEM, F.col("sha256").alias("m_sha"), F.col("size").alias("m_size")
    )
    present = files.where(~F.col("name").isin(_METADATA)).select(
        *_ITEM, F.col("sha256").alias("f_sha"), F.col("size").alias("f_size")
    )
    listed = checksums.select(*_ITEM, F.col("sha256").alias("c_sha"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("m_sha").isNull() & F.col("f_sha").isNotNull(), "not in manifest"),
            F.when(F.col("m_sha").isNotNull() & F.col("f_sha").isNull(), "file missing"),
            F.when(F.col("m_sha") != F.col("f_sha"), "digest differs"),
            F.when(F.col("m_size") != F.col("f_size"), "size differs"),
            F.when(F.col("m_sha").isNotNull() & F.col("c_sha").isNull(), "not in checksum list"),
            F.when(F.col("m_sha").isNull() & F.col("c_sha").isNotNull(), "checksum without artifact"),
            F.when(F.col("m_sha") != F.col("c_sha"), "checksum differs"),
        )
    )
    items = explode_rows(
        recorded.join(present, _ITEM, "full").join(listed, _ITEM, "full"), _ITEM, rules, "reason"
    )
    versions = releases.where(
        F.col("manifest_version") != schemas.RELEASE_MANIFEST_VERSION
    ).select(
        "release",
        F.lit("").alias("name"),
        F.concat(F.lit("unsupported manifest version "), "manifest_version").alias("reason"),
    )
    return items.unionByName(versions)


def check_expected(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Names that are expected but absent, or present but not expected."""
    wanted = expected.select(*_ITEM).distinct().withColumn("wanted", F.lit(True))
    present = (
        files.where(~F.col("name").isin(_METADATA))
        .select(*_ITEM)
        .distinct()
        .withColumn("present", F.lit(True))
    )
    return (
        wanted.join(present, _ITEM, "full")
        .where(F.col("wanted").isNull() | F.col("present").isNull())
        .select(
            *_ITEM,
            F.when(F.col("present").isNull(), "missing").otherwise("unexpected").alias("reason"),
        )
    )


def check_identity(releases: DataFrame, expected: DataFrame) -> DataFrame:
    """Identity fields that differ: release, field, expected, actual.

    Only fields that are expected are compared; empty text counts as absent. An
    expected release that has no metadata differs in every expected field.
    """
    wanted = expected.select(
        "release", *[F.nullif(F.col(f), F.lit("")).alias(f"want_{f}") for f in schemas.IDENTITY_FIELDS]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"want_{f}").alias("expected"),
                F.nullif(F.col(f), F.lit("")).alias("actual"),
            )
            for f in schemas.IDENTITY_FIELDS
        ]
    )
    return (
        wanted.join(releases, "release", "left")
        .select("release", F.explode(pairs).alias("p"))
        .select("release", "p.*")
        .where(
            F.col("expected").isNotNull() & ~F.col("actual").eqNullSafe(F.col("expected"))
        )
    )


def check_source(checkouts: DataFrame, tags: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether checkout, tag and expectation name one commit.

    ``checkouts``: repository, commit. ``tags``: repository, tag, commit.
    ``expected``: repository, tag, commit.
    """
    space_or_nul = r"(?U)[\s\x00]"
    rows = (
        expected.join(
            checkouts.select("repository", F.col("commit").alias("checkout_commit")),
            "repository",
            "left",
        )
        .join(
            tags.select("repository", "tag", F.col("commit").alias("tag_commit")),
            ["repository", "tag"],
            "left",
        )
    )
    reason = (
        F.when((F.col("tag") == "") | (F.col("commit") == ""), "tag and commit must not be empty")
        .when(F.col("tag").startswith("-") | F.col("tag").rlike(space_or_nul), "unsafe tag")
        .when(F.col("commit").rlike(space_or_nul), "unsafe commit")
        .when(F.col("checkout_commit").isNull(), "no checkout")
        .when(F.col("tag_commit").isNull(), "unknown tag")
        .when(
            (F.col("checkout_commit") != F.col("tag_commit"))
            | (F.col("checkout_commit") != F.col("commit")),
            "source does not match",
        )
        .otherwise("ok")
    )
    return rows.withColumn("reason", reason)


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Names that occur more than once in a release."""
    return artifacts.groupBy(*_ITEM).agg(F.count("*").alias("times")).where(F.col("times") > 1)


def lint_artifact_names(files: DataFrame) -> DataFrame:
    """Files that cannot be release artifacts: release, name, reason.

    ``files``: release, raw_name (BINARY), kind.
    """
    name = F.make_valid_utf8(F.col("raw_name").cast("string"))
    normal = text.is_safe_relative("name") & ~F.col("name").rlike(r"(?:\A|/)\.(?:/|\z)|//|/\z")
    rules = F.array_compact(
        F.array(
            F.when(F.col("kind") == "symlink", "symlink"),
            F.when(~F.col("kind").isin("file", "symlink", "directory"), "unsupported file type"),
            F.when(~F.is_valid_utf8(F.col("raw_name").cast("string")), "not valid UTF-8"),
            F.when(F.col("name").rlike("[\n\r]"), "newline in name"),
            F.when(~normal, "not a normal relative path"),
        )
    )
    return explode_rows(files.withColumn("name", name), _ITEM, rules, "reason")
