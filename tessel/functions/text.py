"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space without VT; markers that hide a file
WHITE = "[ \t\n\f\r]+"
PRIVATE = "@(private|experimental|internal)"


def normalize_ws(c: Column) -> Column:
    """Runs of ASCII white space (not VT) become one blank; none is left at the ends."""
    return F.array_join(F.filter(F.split(c, WHITE), lambda x: x != ""), " ")


def escape_data(c: Column) -> Column:
    """Percent sign, CR and LF escaped for an annotation's message."""
    c = F.replace(c, F.lit("%"), F.lit("%25"))
    c = F.replace(c, F.lit("\r"), F.lit("%0D"))
    return F.replace(c, F.lit("\n"), F.lit("%0A"))


def escape_property(c: Column) -> Column:
    """escape_data, then colon and comma, for an annotation's property."""
    c = F.replace(escape_data(c), F.lit(":"), F.lit("%3A"))
    return F.replace(c, F.lit(","), F.lit("%2C"))


def is_private(comment: Column) -> Column:
    return comment.rlike(PRIVATE)


def owner(fqn: Column) -> Column:
    """The component's name: what stands before the first '.prop.'."""
    return F.substring_index(fqn, ".prop.", 1)


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets of the UTF-8 encoding."""
    return F.decode(F.substring(F.encode(c, "utf-8"), start + 1, end - start), "utf-8")


def one_based(c: Column) -> Column:
    return c + 1
