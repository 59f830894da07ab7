"""A report as CI annotations, as one JSON line, and as plain text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_data, escape_property, one_based
from ..schema import CODES, REMOVED_CODE
from ..sources.index import json_surface
from ..sources.sink import write_text


def code(kind: Column) -> Column:
    """Display code of a change kind; null (removed) has its own."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CODES.items()))
    return F.when(kind.isNull(), REMOVED_CODE).otherwise(F.element_at(table, kind))


def _texts() -> tuple[Column, Column, Column]:
    return F.coalesce(F.col("old.text_normalized"), F.lit("")), F.col("new.text_normalized"), F.col("surface.source_token.text_normalized")


# Message forms; {0} old text, {1} new text, {2} text of the surface
DETAILS = {
    "TsMethodParamRemoved": "parameter '{0}' was removed",
    "TsMethodParamTypeChanged": "parameter type changed from '{0}' to '{1}'",
    "TsMethodParamRestChanged": "parameter ...rest changed",
    "TsMethodParamBecameRequired": "parameter became required",
    "TsMethodRequiredParamAdded": "required parameter was added",
    "TsMethodReturnTypeChanged": "return type changed from '{0}' to '{1}'",
    "TsMethodAsyncChanged": "async changed",
    "VuePropTypeChanged": "prop '{2}' type changed from '{0}' to '{1}'",
    "VuePropBecameRequired": "prop '{2}' became required",
    "VueRequiredPropAdded": "required prop '{2}' was added to existing component",
}
LABELS = DETAILS | {"TsMethodParamRemoved": "parameter removed", "TsMethodRequiredParamAdded": "required parameter added"}
BROKEN = "Potential breaking change on public API surface"
GONE = "Removed public API surface"
GONE_LABEL = "was previously defined in this file"


def _filled(forms: dict[str, str]) -> Column:
    values, out = _texts(), None
    for kind, form in forms.items():
        parts, rest = [], form
        while rest:
            lead, mark, rest = rest.partition("{")
            parts += [F.lit(lead)] if lead else []
            if mark:
                number, _, rest = rest.partition("}")
                parts.append(values[int(number)])
        text = F.concat(*parts)
        out = F.when(F.col("kind") == kind, text) if out is None else out.when(F.col("kind") == kind, text)
    return out


def detail() -> Column:
    """What changed, for annotations."""
    return _filled(DETAILS)


def label() -> Column:
    """What changed, for the plain report."""
    return F.when(F.col("kind").isNull(), GONE_LABEL).otherwise(_filled(LABELS))


def message() -> Column:
    fqn, old = F.concat(F.lit(" '"), F.col("surface.fqn"), F.lit("'")), F.concat(F.lit(" Old signature was: '"), F.col("surface.source_token.text_normalized"), F.lit("'"))
    gone = F.concat(F.lit(GONE), fqn, F.lit("."), old)
    broken = F.concat(F.lit(BROKEN), fqn, F.lit(": "), detail(), F.when(F.col("kind").startswith("Ts"), old).otherwise(""))
    return F.when(F.col("kind").isNull(), gone).otherwise(broken)


def github_lines(report: DataFrame) -> DataFrame:
    """fqn and the annotation line of every row of a report; positions count from 1, the file is the surface's."""
    r = F.when(F.col("kind").isNull(), F.col("surface.source_token.source_range")).otherwise(F.col("new.source_range"))
    at = lambda p, f: one_based(r[p][f]).cast("string")
    line = F.concat(
        F.lit("::error file="), escape_property(F.col("surface.file_path")), F.lit(",line="), at("start_point", "row"), F.lit(",col="), at("start_point", "column"),
        F.lit(",endLine="), at("end_point", "row"), F.lit(",endColumn="), at("end_point", "column"), F.lit(",title="), escape_property(code(F.col("kind"))), F.lit("::"), escape_data(message()),
    )
    return report.select(F.col("surface.fqn").alias("fqn"), line.alias("line"))


def json_entries(report: DataFrame) -> DataFrame:
    """section and JSON object of every row of a report; kinds are variant names, absent options null."""
    options = {"ignoreNullFields": "false"}
    token = lambda c: F.coalesce(F.to_json(F.col(c), options), F.lit("null"))
    s = json_surface(F.col("surface"))
    change = F.concat(F.lit('{"surface":'), s, F.lit(',"kind":"'), F.col("kind"), F.lit('","old":'), token("old"), F.lit(',"new":'), token("new"), F.lit("}"))
    return report.select("section", F.when(F.col("kind").isNull(), s).otherwise(change).alias("entry"))


def human_rows(report: DataFrame, files: DataFrame) -> DataFrame:
    """code, headline, fqn, label, help, before, file, line, column, end_line, end_column and the source lines of every row of a report.

    The place is the new token's, or where a removed surface began; a file that is gone has no source lines.
    """
    gone = F.col("kind").isNull()
    r = F.when(gone, F.col("surface.source_token.source_range")).otherwise(F.col("new.source_range"))
    end = F.when(gone, r["start_point"]).otherwise(r["end_point"])
    vue = F.coalesce(F.col("kind").startswith("Vue"), F.lit(False))
    row = report.select(
        code(F.col("kind")).alias("code"), F.when(gone, GONE).otherwise(BROKEN).alias("headline"), F.col("surface.fqn").alias("fqn"), label().alias("label"),
        F.when(~vue, F.concat(F.lit("old signature was: "), F.col("surface.source_token.text_normalized"))).alias("help"),
        F.when(F.col("old").isNotNull(), F.concat(F.lit("before: "), F.col("old.text_normalized"))).alias("before"), F.col("surface.file_path").alias("file"),
        one_based(r["start_point"]["row"]).alias("line"), one_based(r["start_point"]["column"]).alias("column"), one_based(end["row"]).alias("end_line"), one_based(end["column"]).alias("end_column"),
    )
    # one row each, and said so: where no source lines are asked for, Spark leaves out the join
    one = files.select(F.col("repo_path").alias("file"), "content").groupBy("file").agg(F.first("content").alias("content"))
    lines = one.select("file", F.split("content", "\n").alias("_lines"))
    text = F.coalesce(F.slice("_lines", F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int")), F.array().cast("array<string>"))
    return row.join(lines, "file", "left").select(*row.columns, text.alias("source"))


def _frame() -> Column:
    """The source lines with their numbers, what is meant underlined, and the label after the last."""
    width = F.length(F.col("end_line").cast("string"))
    gutter = F.concat(F.lit(" "), F.repeat(F.lit(" "), width), F.lit(" | "))

    def marked(line: Column, i: Column) -> Column:
        number, line = F.col("line") + i, F.regexp_replace(line, "\r+$", "")
        # columns count bytes; a character that is cut counts as one
        cut = lambda column: F.length(F.substring(line.cast("binary"), F.lit(1), (column - 1).cast("int")).cast("string"))
        start = F.when(i == 0, cut(F.col("column"))).otherwise(F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", "")))
        end = F.when(number == F.col("end_line"), cut(F.col("end_column"))).otherwise(F.length(line))
        under = F.concat(gutter, F.repeat(F.lit(" "), start), F.repeat(F.lit("^"), F.greatest(F.lit(1), end - start)))
        return F.concat(F.lit(" "), F.lpad(number.cast("string"), width, F.lit(" ")), F.lit(" | "), line, F.lit("\n"), under)

    lines = F.concat(F.array_join(F.transform("source", marked), "\n"), F.lit(" "), F.col("label"))
    return F.when(F.size("source") > 0, lines).otherwise(F.concat(gutter, F.col("label")))


def human_entry() -> Column:
    """Plain text of a row of human_rows."""
    note = lambda lead, c: F.when(F.length(c) > 0, F.concat(F.lit(f"    = {lead}: "), F.col(c), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("["), F.col("code"), F.lit("] Error: "), F.col("headline"), F.lit("\n   --> "), F.col("file"), F.lit(":"), F.col("line"), F.lit(":"), F.col("column"), F.lit("\n"), _frame(), F.lit("\n"),
        note("help", "help"), F.lit("    = note: API surface: "), F.col("fqn"), F.lit("\n"), note("note", "before"),
    )


FORMATS = ("human", "github", "json")


def write(report: DataFrame, path: str, fmt: str, files: DataFrame | None = None) -> None:
    """A report as one file, rendered, ordered and written by the tasks: plain text by file and place (files has the source lines), annotations by name, or JSON {"removed":[...],"breaking_changes":[...]} on one line."""
    if fmt == "json":
        section = F.when(F.col("section") == "removed", 0).otherwise(1)
        write_text(json_entries(report), path, F.col("entry"), ["entry"], section, ('{"removed":[', '],"breaking_changes":['), ",", "]}")
    elif fmt == "github":
        write_text(github_lines(report), path, F.col("line"), ["fqn", "line"])
    elif fmt == "human":
        write_text(human_rows(report, files), path, human_entry(), ["file", "line", "column", "fqn", "code"])
    else:
        raise ValueError(f"unknown format {fmt}")
