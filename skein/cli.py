"""Plans a question from a planner's answer on the command line: the plan is printed as JSON."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.plans import planner


def log_to(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Messages of this package to standard error, and to a file if one is named."""
    log = logging.getLogger("skein")
    log.setLevel(level)
    for h in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query")
    p.add_argument("--response", help="the planner's answer; read from standard input by default")
    p.add_argument("--max-subqueries", type=int, default=5)
    p.add_argument("--request", action="store_true", help="print the message for the planner instead")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    row = spark.createDataFrame([(a.query, None if a.request else a.response if a.response is not None else sys.stdin.read())], "q string, r string")
    out = planner.request(F.col("q"), a.max_subqueries) if a.request else F.to_json(planner.plan(F.col("q"), F.col("r"), a.max_subqueries))
    print(row.select(out).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
