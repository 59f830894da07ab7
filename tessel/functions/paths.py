"""Rules on repository paths as Columns; separators are slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions, pruned directories, the admin tree
EXTENSIONS = ("php", "js", "ts", "twig")
PRUNED = ("tests", "test")
ADMIN = ("Resources", "app", "administration")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without a dot."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def is_source(path: Column) -> Column:
    """The file name has one of the source extensions."""
    return extension(path).isin(*EXTENSIONS)


def is_spec(path: Column) -> Column:
    """The file name without its extension ends with .spec."""
    return file_name(path).rlike(r"\.spec\.[^.]*$")


def in_tests(path: Column) -> Column:
    """Some directory of the path is named test or tests."""
    p = parts(path)
    return F.exists(F.slice(p, 1, F.size(p) - 1), lambda x: x.isin(*PRUNED))


def is_admin(path: Column) -> Column:
    """The first directory named Resources is followed by app/administration."""
    p = parts(path)
    at = F.array_position(p, ADMIN[0]).cast("int")
    return (at > 0) & F.coalesce(F.get(p, at) == ADMIN[1], F.lit(False)) & F.coalesce(F.get(p, at + 1) == ADMIN[2], F.lit(False))


def dispatch(path: Column) -> Column:
    """vue for js and ts files of the admin tree, else none: the other languages have no extraction."""
    return F.when(extension(path).isin("js", "ts") & is_admin(path), "vue").otherwise("none")


def scanned(path: Column) -> Column:
    """The walk's rules together."""
    return is_source(path) & ~is_spec(path) & ~in_tests(path)


def component_from_template(imported: Column) -> Column:
    """The component named by an import such as ./name.html.twig; null for other imports.

    The text is split at its first slash; what follows must hold no other, and gives the name up to its first dot.
    """
    rest = F.when(F.instr(imported, "/") > 0, F.regexp_extract(imported, r"(?s)^[^/]*/(.*)$", 1))
    return F.when(imported.endswith(".html.twig") & rest.isNotNull() & (F.instr(rest, "/") == 0), F.substring_index(rest, ".", 1))


def component_from_path(path: Column) -> Column:
    """The name of the file's directory; null at the root."""
    name = F.try_element_at(parts(path), F.lit(-2))
    return F.when(name != "", name)
