"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def default_config(name: str) -> dict:
    return read_config(str(Path(__file__).resolve().parent / f"{name}.json"))


def read_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def arguments(name: str, about: str, **paths: str) -> argparse.Namespace:
    """The command line: a required option per path, and the config file."""
    p = argparse.ArgumentParser(prog=f"jobs/{name}.py", description=about)
    for option, help_ in paths.items():
        p.add_argument(f"--{option}", required=True, help=help_)
    p.add_argument("--config", default=None, help=f"JSON file; jobs/{name}.json if not given")
    out = p.parse_args()
    out.config = read_config(out.config) if out.config else default_config(name)
    return out


def start(name: str) -> SparkSession:
    """The session of a command line; master and settings are those of spark-submit or the environment."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if os.path.isdir(os.path.join(ROOT, "tessera")):
        from tessera.functions.shipping import ship_package

        ship_package(spark)
    return spark
