"""Text rules: trimming, lines, dates, paths, byte distance, shell quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"\p{Cc}"
NUL = "\u0000"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim(value: str | Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(_col(value), r"(?U)\A\s+|\s+\z", "")


def is_blank(value: str | Column) -> Column:
    return ~_col(value).rlike(r"(?U)\S")


def first_text_line(value: str | Column) -> Column:
    """The first line that is not blank, or null."""
    line = F.regexp_extract(_col(value), r"(?U)\A(?:\s*\n)?([^\n]*)", 1)
    return F.when(~is_blank(line), F.regexp_replace(line, r"\r\z", ""))


def lines(value: str | Column) -> Column:
    """Lines without their ends; a final newline does not open another line."""
    pieces = F.split(_col(value), "\r?\n", -1)
    return F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).otherwise(pieces)


def lines_with_ends(value: str | Column) -> Column:
    """Lines that keep their newline, so joining them restores the text."""
    return F.filter(F.split(_col(value), "(?<=\n)", -1), lambda line: line != "")


def is_date(value: str | Column) -> Column:
    """A real calendar date written with exactly ten characters."""
    value = _col(value)
    return F.coalesce(
        value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & value.try_cast("date").isNotNull(),
        F.lit(False),
    )


def is_identifier(value: str | Column) -> Column:
    """Not empty and free of control characters."""
    value = _col(value)
    return (value != "") & ~value.rlike(CONTROL)


def is_absolute(path: str | Column) -> Column:
    return _col(path).startswith("/")


def has_parent_step(path: str | Column) -> Column:
    return _col(path).rlike(r"(?:\A|/)\.\.(?:/|\z)")


def is_safe_relative(path: str | Column) -> Column:
    """Not empty, relative, and never stepping to a parent folder."""
    return (_col(path) != "") & ~is_absolute(path) & ~has_parent_step(path)


def bytes_as_chars(value: str | Column) -> Column:
    """The UTF-8 bytes of a text as one character each."""
    return F.decode(F.encode(_col(value), "UTF-8"), "ISO-8859-1")


def byte_distance(left: Column, right: Column, threshold: int | None = None) -> Column:
    """Edit distance counted in bytes."""
    return F.levenshtein(bytes_as_chars(left), bytes_as_chars(right), threshold)


def quote_argument(argument: Column) -> Column:
    """Show one argument the way a shell user would type it."""
    quoted = F.concat(F.lit("'"), F.replace(argument, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(argument.rlike(r"\A[A-Za-z0-9\-_.=/:+]*\z"), argument).otherwise(quoted)


def quote_command(command: str | Column) -> Column:
    return F.array_join(F.transform(_col(command), quote_argument), " ")


def framed(value: Column) -> Column:
    """Length-prefixed text, so that neighbours cannot run into each other."""
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def framed_list(values: Column) -> Column:
    """Element count followed by every element, length-prefixed."""
    return F.concat(
        F.size(values).cast("string"), F.lit("#"), F.array_join(F.transform(values, framed), "")
    )
