"""What the command lines share: a session, and settings from a file and arguments."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def settings(args: list[str]) -> dict:
    """The settings of a JSON file, with those given as name=value in place of its own; a
    value that isn't JSON is text."""
    if not args:
        raise SystemExit("give the path of a settings file, then name=value for what differs")
    found = json.loads(Path(args[0]).read_text())
    for pair in args[1:]:
        name, mark, value = pair.partition("=")
        if not mark or name not in found:
            raise SystemExit(f"no setting {name!r}; there are {', '.join(found)}")
        try:
            found[name] = json.loads(value)
        except json.JSONDecodeError:
            found[name] = value
    return found


@contextmanager
def session(name: str) -> Iterator[SparkSession]:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        yield spark
    finally:
        spark.stop()
