"""Feed logs: JSON lines with a line ordinal, as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "line long, event string, received_at_utc string, connection_id string, reason string, raw_text string, _bad string"


def parsed(lines: DataFrame) -> DataFrame:
    """value texts as events; a line that is not JSON becomes event 'malformed'. The recorder writes the ordinal line."""
    read = lines.withColumn("j", F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).select("source", "value", "j.*")
    bad = F.col("_bad").isNotNull() | F.col("event").isNull()
    return read.select("source", "line", F.when(bad, "malformed").otherwise(F.col("event")).alias("event"), "received_at_utc", "connection_id", "reason", "raw_text")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path).withColumn("source", F.input_file_name()))


def stream_log(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return parsed(spark.readStream.option("maxFilesPerTrigger", files).text(path).withColumn("source", F.lit(path)))
