"""What the jobs share: their config, their log and their command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """A config file over the defaults; read by Spark, so that it may lie where only Spark reads. An unknown name is an error."""
    if not path:
        return dict(defaults)
    found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := sorted(set(found) - set(defaults)):
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return defaults | found


def command(name: str, paths: dict[str, str], run: Callable[[SparkSession, argparse.Namespace], object], args: list[str] | None = None) -> int:
    """Parse paths and --config, start a session, run, stop the session."""
    parser = argparse.ArgumentParser(prog=name)
    for path, meaning in paths.items():
        parser.add_argument(path, help=meaning)
    parser.add_argument("--config", help="a JSON file")
    found = parser.parse_args(args)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, found)
    finally:
        spark.stop()
    return 0
