"""Inventories of stored panels, sampled series, calendar histograms, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.schemas import GROUPS


def inventory(frame: DataFrame, file: str | None = None) -> DataFrame:
    """rows, first and last time, markets and symbols of each file (or of each exchange and timeframe); one pruned pass."""
    keys = [F.col(file)] if file else [F.col("exchange"), F.col("timeframe")]
    return frame.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_distinct("symbol").alias("symbols"), F.min("symbol").alias("first_symbol"))


def parquet_inventory(spark, path: str) -> DataFrame:
    """inventory() of the Parquet files under a path."""
    return inventory(spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path")), "file")


def footer_inventory(spark, path: str, columns: tuple[str, ...]) -> DataFrame:
    """rows, and least_ and most_ of columns (numbers, dates or booleans) of the Parquet files under a path, from the statistics
    in their footers: no data is read.

    It runs in a session of its own, since the push-down of aggregates needs the newer Parquet reader.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "least"), (F.max, "most"))))


def sampled_series(frame: DataFrame, max_points: int = 480) -> DataFrame:
    """Every k-th bar of each market, k = ceil(bars / max_points)."""
    w = Window.partitionBy(*GROUPS)
    rows = frame.withColumns({"_n": F.row_number().over(w.orderBy("timestamp")), "_k": F.ceil(F.count("*").over(w) / max_points)})
    return rows.where((F.col("_n") - 1) % F.col("_k") == 0).drop("_n", "_k")


def markdown(frame: DataFrame, limit: int = 50) -> str:
    """A small summary as a table; rows beyond the limit are counted below it."""
    rows = frame.limit(limit + 1).collect()
    shown = [" | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows[:limit]]
    more = ["", f"(more than {limit} rows)"] if len(rows) > limit else []
    return "\n".join([" | ".join(frame.columns), " | ".join("-" for _ in frame.columns), *shown, *more])
