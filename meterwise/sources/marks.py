"""Small JSON documents beside a table: how far a job has come."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from meterwise.sources.snapshots import _file_system


def write_mark(spark: SparkSession, path: str, values: dict) -> None:
    """Replaces the document; readers see the old one or the new one."""
    place, fs = _file_system(spark, path)
    aside, _ = _file_system(spark, f"{path}.new")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(values), "utf-8"))
    stream.close()
    if not fs.rename(aside, place):
        # File systems that do not rename over a file.
        fs.delete(place, False)
        fs.rename(aside, place)


def read_mark(spark: SparkSession, path: str) -> dict | None:
    """The document; of one that was being replaced when its writer died, the new one."""
    for name in (path, f"{path}.new"):
        place, fs = _file_system(spark, name)
        if fs.exists(place):
            stream = fs.open(place)
            text = bytes(stream.readAllBytes()).decode("utf-8")
            stream.close()
            return json.loads(text)
    return None
