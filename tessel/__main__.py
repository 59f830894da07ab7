"""python -m tessel index|check PATH --project NAME [-i INDEX] [-f human|github|json]"""

from __future__ import annotations

import argparse
import codecs
import logging
import os
import sys
import uuid

from pyspark.sql import SparkSession

from .plans import engine
from .sources.shared import blocks, delete, shared_dir


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessel")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "check"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--project", required=True, help="the name that composer.json must have")
        c.add_argument("-i", "--index", default="./index.json")
        if name == "check":
            c.add_argument("-f", "--format", choices=("human", "github", "json"), default="human")
    a = p.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if a.verbose else os.environ.get("TESSEL_LOG", "WARNING"))
    spark = SparkSession.builder.appName("tessel").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine.validate(spark)
    if a.command == "index":
        n = engine.index(spark, a.path, a.project, a.index)
        logging.getLogger("tessel").info("%d surfaces", n)
        return 0 if n else 1
    to = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    broken, _ = engine.check(spark, a.path, a.project, a.index, a.format, to)
    if broken:
        text = codecs.getincrementaldecoder("utf-8")()
        for block in blocks(to):
            sys.stdout.write(text.decode(block))
        sys.stdout.write("\n")
        delete(to)
    return int(broken)


if __name__ == "__main__":
    sys.exit(main())
