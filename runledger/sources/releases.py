"""Release folders: file inventories, checksum lists, expected names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import ordered, text
from runledger.session import settle
from runledger.sources import blocks, published


def read_file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: path (relative), size, sha256.

    The digest is taken where the file is read; content does not travel. One
    file must fit into a row (2 GiB). The two release metadata files at the top
    are left out.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    # The scheme part of the location is not kept by every path, so the folder
    # is located by its own text.
    folder = path.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.substr(
        F.col("path"), F.instr(F.col("path"), folder) + len(folder) + 1
    )
    return files.select(
        relative.alias("path"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2("content", 256).alias("sha256"),
    ).where(
        ~F.col("path").isin(schemas.RELEASE_METADATA_FILE, schemas.RELEASE_CHECKSUM_FILE)
    )


def _numbered_lines(texts: DataFrame) -> DataFrame:
    return texts.select("file", F.posexplode(text.lines(F.col("text"))).alias("i", "line")).select(
        "file", (F.col("i") + 1).cast("bigint").alias("line_no"), "line"
    )


def _bad_name(name: Column) -> Column:
    return (name == "") | text.is_absolute(name) | text.has_parent_step(name)


def _without_repeats(rows: DataFrame) -> DataFrame:
    """Mark every repetition of a name in its file."""
    earlier = Window.partitionBy("file", "name").orderBy("line_no")
    repeated = F.col("error").isNull() & (F.row_number().over(earlier) > 1)
    return rows.withColumn("error", F.when(repeated, "duplicate name").otherwise(F.col("error")))


def _checksums(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = lines.where(~text.is_blank("line"))
    at = F.instr("line", "  ")
    digest = F.substr("line", F.lit(1), at - 1)
    name = F.regexp_replace(F.substr("line", at + 2), r"\A\*", "")
    error = (
        F.when(at == 0, "expected digest and name")
        .when(~digest.rlike(r"\A[0-9A-Fa-f]{64}\z"), "invalid digest")
        .when(_bad_name(name), "invalid name")
    )
    judged = rows.withColumn("error", error).select(
        "file",
        "line_no",
        F.when(F.col("error").isNull(), name).alias("name"),
        F.when(F.col("error").isNull(), F.lower(digest)).alias("sha256"),
        "error",
    )
    good = judged.where(F.col("error").isNull())
    checked = _without_repeats(good)
    entries = checked.where(F.col("error").isNull()).select("file", "name", "sha256")
    empty = files.select("file").join(good.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit(0).cast("bigint").alias("line_no"), F.lit("no artifacts").alias("error")
    )
    errors = (
        judged.where(F.col("error").isNotNull())
        .select("file", "line_no", "error")
        .unionByName(
            checked.where(F.col("error").isNotNull()).select("file", "line_no", "error")
        )
        .unionByName(empty)
    )
    return entries, errors


def parse_checksums(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, text`` to checksums (file, name, sha256) and line errors.

    An error row names the line; a list without any entry has line 0.
    """
    return _checksums(_numbered_lines(texts), texts.select("file").distinct())


def read_checksums(
    spark: SparkSession, path: str, by_folder: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Checksum lists below ``path``, as by :func:`parse_checksums`, each read by many tasks.

    With ``by_folder`` the files of a folder are parts of one list, as
    ``write_release_outputs`` leaves them; its lines are numbered across them.
    """
    lines = settle(blocks.numbered_lines(spark, path, by_folder), "checksum-lines")
    return _checksums(lines, blocks.files_below(spark, path, by_folder))


def _expected_names(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = lines.withColumn("name", text.trim("line")).where(F.col("name") != "")
    judged = rows.withColumn("error", F.when(_bad_name(F.col("name")), "invalid name"))
    bad = judged.where(F.col("error").isNotNull())
    checked = _without_repeats(judged.where(F.col("error").isNull()))
    return (
        checked.where(F.col("error").isNull()).select("file", "name"),
        bad.unionByName(checked.where(F.col("error").isNotNull())).select(
            "file", "line_no", "error"
        ),
    )


def parse_expected_names(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, text`` to expected names (file, name) and line errors."""
    return _expected_names(_numbered_lines(texts))


def read_expected_names(
    spark: SparkSession, path: str, by_folder: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Expected-name lists below ``path``, as by :func:`parse_expected_names`, each read by many tasks."""
    return _expected_names(settle(blocks.numbered_lines(spark, path, by_folder), "expected-lines"))


def release_lines(heads: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Lines of the metadata document and the checksum list of each release.

    Result: release, document (metadata or checksums), part, name, line; in
    the order of part and name the metadata lines form one JSON document.
    """
    first = artifacts.groupBy("release").agg(F.min("name").alias("first_name"))
    item = F.to_json(F.struct("name", "sha256", "size"))
    listed = artifacts.join(first, "release")
    comma = F.when(F.col("name") == F.col("first_name"), "").otherwise(",")

    def lines(rows: DataFrame, document: str, part: int, name: Column, line: Column) -> DataFrame:
        return rows.select(
            "release",
            F.lit(document).alias("document"),
            F.lit(part).alias("part"),
            name.alias("name"),
            line.alias("line"),
        )

    opening = F.concat(
        F.regexp_replace("head", r"\}\z", ""), F.lit(',"artifacts":[')
    )
    return (
        lines(heads, "metadata", 0, F.lit(""), opening)
        .unionByName(lines(listed, "metadata", 1, F.col("name"), F.concat(comma, item)))
        .unionByName(lines(heads, "metadata", 2, F.lit(""), F.lit("]}")))
        .unionByName(
            lines(artifacts, "checksums", 1, F.col("name"),
                  F.concat("sha256", F.lit("  "), F.col("name")))
        )
    )


def _in_order(heads: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The lines range-partitioned and sorted; what they are made of is worked out once."""
    order = ["document", "release", "part", "name"]
    tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = release_lines(settle(heads, "release-heads"), settle(artifacts, "release-artifacts"))
    return lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def write_release_outputs(heads: DataFrame, artifacts: DataFrame, path: str) -> None:
    """Metadata and checksum files below ``document=…/release=…``.

    Lines are range-partitioned in order, so the part files of a folder, read
    by name, are the document, and a huge release is written by many tasks. Each
    release costs two folders; many are better kept by :func:`write_release_table`.
    """
    (
        _in_order(heads, artifacts)
        .select("document", "release", F.col("line").alias("value"))
        .write.partitionBy("document", "release")
        .text(path)
    )


def write_release_table(heads: DataFrame, artifacts: DataFrame, path: str) -> None:
    """The same documents as rows of one table: document, release, part, name, line and task.

    Files follow the bytes, not the number of releases. The lines of a document are in
    the order of part and name; ``task`` never decreases along it, so the lines of a
    huge release can be numbered without gathering them.
    """
    _in_order(heads, artifacts).withColumn("task", F.spark_partition_id().cast("bigint")).write.partitionBy(
        "document"
    ).parquet(path)


def read_release_lines(spark: SparkSession, path: str, document: str) -> DataFrame:
    """``release, part, name, line, task`` of one kind of document in a release table."""
    schema = "release STRING, part INT, name STRING, line STRING, task BIGINT"
    return spark.read.schema(schema).parquet(f"{path}/document={document}")


def read_checksum_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Checksum lists of a release table, as by :func:`parse_checksums`; ``file`` is the release."""
    stored = read_release_lines(spark, path, "checksums")
    placed = ordered.position(stored, ["release"], ["part", "name"], F.col("task"), "line_no")
    lines = settle(
        placed.select(F.col("release").alias("file"), (F.col("line_no") + 1).alias("line_no"), "line"), "checksum-lines"
    )
    return _checksums(lines, lines.select("file").distinct())


def read_metadata_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata documents of a release table, as by :func:`read_release_metadata`."""
    return _metadata(read_release_lines(spark, path, "metadata").select("release", "line"))


def read_release_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata documents that :func:`write_release_outputs` left below ``path``.

    Heads (release, manifest_version and the identity fields), artifacts (release, name,
    sha256, size) and releases whose document has no beginning or no end (release,
    error). Documents are read line by line, a huge one by many tasks.
    """
    release = published.decoded(
        published.decoded(F.regexp_extract(F.col("_metadata.file_path"), r"/release=([^/]+)/[^/]*$", 1))
    )
    return _metadata(
        spark.read.option("recursiveFileLookup", True).text(f"{path}/document=metadata").select(
            release.alias("release"), F.col("value").alias("line")
        )
    )


def _metadata(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    opening = ',"artifacts":['
    lines = lines.withColumn(
        "part", F.when(F.col("line").endswith(opening), 0).when(F.col("line") == "]}", 2).otherwise(1)
    )
    fields = "manifest_version BIGINT, " + ", ".join(f"{f} STRING" for f in schemas.IDENTITY_FIELDS)
    head = F.from_json(F.concat(F.left("line", F.length("line") - len(opening)), F.lit("}")), fields)
    item = F.from_json(F.regexp_replace("line", r"\A,", ""), "name STRING, sha256 STRING, size BIGINT")
    whole = lines.groupBy("release").agg(
        F.count_if(F.col("part") == 0).alias("heads"), F.count_if(F.col("part") == 2).alias("ends")
    )
    return (
        lines.where("part = 0").select("release", head.alias("h")).select("release", "h.*"),
        lines.where("part = 1").select("release", item.alias("i")).select("release", "i.*"),
        whole.where("heads <> 1 OR ends <> 1").select("release", F.lit("incomplete document").alias("error")),
    )
