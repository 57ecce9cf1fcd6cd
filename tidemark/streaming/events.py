"""A run's event log as a stream: new lines of JSON as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seq bigint, kind string, at double, run string, stage string, status string, seconds double, name string, value double, text string, error string"


def event_stream(spark: SparkSession, runs: str) -> DataFrame:
    """Events of all runs under the folder `runs`, a row an event, with the file that it came from."""
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "events.jsonl").json(runs).selectExpr("*", "_metadata.file_path as log")
