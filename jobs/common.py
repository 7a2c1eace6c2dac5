"""What both jobs share: config, logging, and the session of the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("rankloom.jobs")


def settings(file: str, **given) -> dict:
    """The job's config file (``file`` with .json in place of .py), with what was given on top; unknown names are refused."""
    known = json.loads(Path(file).with_suffix(".json").read_text())
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return known | given


def command_line(file: str, description: str, *paths: str) -> tuple[argparse.Namespace, dict, SparkSession]:
    """Arguments, settings and a session; the caller stops the session."""
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(f"--{name.replace('_', '-')}", required=True, help="a path that Spark can open")
    parser.add_argument("--config", help="a JSON file whose settings replace those beside the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(Path(file).stem).getOrCreate()
    more = json.loads("\n".join(r[0] for r in spark.read.text(args.config).collect())) if args.config else {}
    return args, settings(file, **more), spark
