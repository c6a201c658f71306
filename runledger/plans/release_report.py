"""From release folders to one verdict per release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import release


def release_report(
    releases: DataFrame,
    artifacts: DataFrame,
    files: DataFrame,
    checksums: DataFrame,
    identity: DataFrame,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Number of differences per release; zero means verified.

    ``releases``: release, manifest_version and the identity fields.
    """
    found = [
        release.verify_inventory(releases, artifacts, files, checksums).select("release"),
        release.check_identity(releases, identity).select("release"),
    ]
    if expected is not None:
        found.append(release.check_expected(expected, files).select("release"))
    differences = found[0]
    for rows in found[1:]:
        differences = differences.unionByName(rows)
    counts = differences.groupBy("release").agg(F.count("*").alias("differences"))
    return releases.select("release").join(counts, "release", "left").select(
        "release",
        F.coalesce("differences", F.lit(0)).alias("differences"),
        F.col("differences").isNull().alias("verified"),
    )
