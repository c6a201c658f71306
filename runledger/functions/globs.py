"""Ordered path patterns.

``*`` stays inside one path segment, ``**`` as a whole segment stands for any
number of segments (also none), a leading ``!`` excludes, everything else is
literal, and the last pattern that matches decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = r"([\\.\[\]{}()+^$|?\-])"


def _segment_regex(segment: Column) -> Column:
    literal = F.regexp_replace(segment, _META, r"\\$1")
    return F.when(segment == "**", F.lit("(?:[^/]*/)*")).otherwise(
        F.concat(F.regexp_replace(literal, r"\*+", "[^/]*"), F.lit("/"))
    )


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression, to be matched against ``path || '/'``."""
    body = F.array_join(F.transform(F.split(pattern, "/", -1), _segment_regex), "")
    return F.concat(F.lit(r"\A"), body, F.lit(r"\z"))


def compile_patterns(patterns: Column) -> Column:
    """``ARRAY<STRING>`` to ``ARRAY<STRUCT<idx, exclude, source, prefix, regex, folder, tail>>``.

    A path that the pattern matches has ``folder`` among its :func:`path_folders`
    and ``tail`` among its :func:`path_tails`.
    """

    def compiled(pattern: Column, idx: Column) -> Column:
        exclude = pattern.startswith("!")
        source = F.when(exclude, F.substr(pattern, F.lit(2))).otherwise(pattern)
        last = F.substring_index(source, "/", -1)
        ending = F.regexp_extract(last, r"\A[^*]*\*+(\.[^*.]+)\z", 1)
        return F.struct(
            idx.cast("bigint").alias("idx"),
            exclude.alias("exclude"),
            source.alias("source"),
            F.substring_index(source, "*", 1).alias("prefix"),
            glob_regex(source).alias("regex"),
            # The folders before the first wildcard, all literal.
            F.regexp_extract(F.substring_index(source, "*", 1), r"\A([\s\S]*)/", 1).alias("folder"),
            # A literal name, or a literal ending of it, or nothing to go by.
            F.when(~last.contains("*"), F.concat(F.lit("name:"), last))
            .when(ending != "", F.concat(F.lit("ending:"), ending))
            .otherwise("").alias("tail"),
        )

    return F.transform(patterns, compiled)


def path_folders(path: Column) -> Column:
    """The path itself and all folders above it, the outermost one empty."""
    parts = F.split(path, "/", -1)
    depths = F.sequence(F.lit(1), F.size(parts))
    return F.array_distinct(
        F.concat(
            F.array(F.lit("")),
            F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
        )
    )


def path_tails(path: Column) -> Column:
    """What a pattern's ``tail`` may be for this path."""
    name = F.substring_index(path, "/", -1)
    ending = F.concat(F.lit("ending:."), F.substring_index(name, ".", -1))
    return F.array(F.lit(""), F.concat(F.lit("name:"), name), ending)


def matches(path: Column, pattern: Column) -> Column:
    """Whether one compiled pattern matches.

    The literal start of the pattern is compared first, so paths it can never
    reach do not run the regular expression; nor do patterns without wildcard,
    or with all of a folder, which the start decides.
    """
    subject = F.concat(path, F.lit("/"))
    source, prefix = pattern["source"], pattern["prefix"]
    whole_folder = (source == F.concat(prefix, F.lit("**"))) & ((prefix == "") | prefix.endswith("/"))
    return subject.startswith(prefix) & F.when(whole_folder, True).when(
        source == prefix, path == source
    ).otherwise(F.rlike(subject, pattern["regex"]))


def selects(path: Column, compiled: Column) -> Column:
    """Whether the ordered list selects the path."""
    return F.aggregate(
        compiled,
        F.lit(False),
        lambda selected, p: F.when(matches(path, p), ~p["exclude"]).otherwise(selected),
    )
