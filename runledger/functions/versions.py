"""Strict ``major.minor.patch`` versions with unsigned 64-bit parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.rows import bind

# The largest unsigned 64-bit number, and the strict version form.
U64_MAX = "18446744073709551615"
VERSION_FORM = r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\z"

VERSION_TYPE = "struct<major:decimal(20,0),minor:decimal(20,0),patch:decimal(20,0)>"


def u64_max() -> Column:
    return F.lit(U64_MAX).cast("decimal(20,0)")


def parse_version(text: Column) -> Column:
    """Version struct, or null when the text is not a strict version."""
    numbers = F.transform(F.split(text, r"\."), lambda part: part.try_cast("decimal(20,0)"))

    def version(parts: Column) -> Column:
        fits = F.forall(parts, lambda part: F.coalesce(part <= u64_max(), F.lit(False)))
        names = ("major", "minor", "patch")
        return F.when(
            fits, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
        )

    return F.when(text.rlike(VERSION_FORM), bind(numbers, version))


def format_version(version: Column) -> Column:
    dot = F.lit(".")
    major, minor, patch = [version[n].cast("string") for n in ("major", "minor", "patch")]
    return F.concat(major, dot, minor, dot, patch)
