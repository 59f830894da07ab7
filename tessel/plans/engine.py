"""What a user calls: scan, index and check."""

from __future__ import annotations

import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators.diff import diff
from ..operators.extract import extract
from ..operators.surfaces import counted
from ..schema import SURFACE
from ..sources import index as store
from ..sources.files import read_files, validate_root
from ..sources.shared import blocks, delete, shared_dir
from . import output

JSON = (".json", ".json.gz")
log = logging.getLogger(__name__)


def validate(spark: SparkSession) -> None:
    """Check all rules, formats and the comparison before a run: Spark analyses them on empty snapshots, and patterns are compiled."""
    none = spark.createDataFrame([], SURFACE)
    report = diff(none, none)
    files = spark.createDataFrame([], "repo_path string, content string")
    for df in (output.github_lines(report), output.json_entries(report), output.human_rows(report, files).select(output.human_entry()), store.json_lines(none)):
        df.schema  # noqa: B018
    path = F.lit("a/b.ts")
    spark.range(1).select(text.normalize_ws(path), text.is_private(path), paths.scanned(path), paths.dispatch(path), paths.component_from_template(path), paths.component_from_path(path)).collect()


def _scanned(spark: SparkSession, root: str | Path, project: str) -> DataFrame:
    """``scan`` with n, kept for what reads it next: files are read and extracted once."""
    found = counted(extract(read_files(spark, validate_root(root, project, spark)))).persist()
    report_duplicates(found)
    return found


def scan(spark: SparkSession, root: str | Path, project: str) -> DataFrame:
    """The surfaces of a project's tree, one for each fqn; fqns that overwrite others are logged. The rows are kept in Spark's cache, so the tree is extracted once."""
    return _scanned(spark, root, project).drop("n")


def report_duplicates(surfaces: DataFrame) -> None:
    """Log the fqns that are defined more than once."""
    for r in surfaces.where("n > 1").select("fqn", "n").toLocalIterator():
        log.error("%s is defined %d times", r["fqn"], r["n"])


def index(spark: SparkSession, root: str | Path, project: str, path: str = "index.json") -> int:
    """Scan and save; the number of surfaces. Nothing is saved if there are none. A path ending in .json or .json.gz is one JSON object, else Parquet."""
    found = _scanned(spark, root, project)
    try:
        n = found.count()
        log.info("%d surfaces found", n)
        if n:
            (store.save_json if path.endswith(JSON) else store.save)(found.drop("n"), path)
        return n
    finally:
        found.unpersist()


def check(spark: SparkSession, root: str | Path, project: str, path: str = "index.json", fmt: str = "human", out: str | None = None) -> tuple[bool, str]:
    """Whether the tree breaks the saved index, and the report in the format human, github or json; without breaks it is empty.

    With out, the report is written to that file, which executors must see, and its path returned; without it, the text.
    """
    if fmt not in output.FORMATS:
        raise ValueError(f"unknown format {fmt}")
    base = (store.load_json(spark, path) if path.endswith(JSON) else store.load(spark, path)).persist()
    found = _scanned(spark, root, project)
    report = diff(base, found.drop("n")).persist()
    try:
        if log.isEnabledFor(logging.INFO):
            log.info("%d surfaces loaded, %d found", base.count(), found.count())
        if report.isEmpty():
            return False, ""
        to = out or f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
        output.write(report, to, fmt, read_files(spark, validate_root(root, project, spark)) if fmt == "human" else None)
        if out:
            return True, out
        whole = b"".join(blocks(to)).decode()
        delete(to)
        return True, whole
    finally:
        for df in (report, found, base):
            df.unpersist()
