"""Canonical frames of the panel engine: schemas, keys and interval arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _TS, _L = T.StringType(), T.DoubleType(), T.TimestampType(), T.LongType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# The columns and keys of each kind of panel.
SCHEMAS = {
    "ohlcv": _schema(("exchange", _S), ("symbol", _S), ("timeframe", _S), ("timestamp", _TS), *((c, _D) for c in ("open", "high", "low", "close", "volume")), ("observed_at", _TS)),
    "orderbook": _schema(("exchange", _S), ("symbol", _S), ("observed_at", _TS), ("exchange_timestamp", _TS), ("side", _S), ("level", _L), ("price", _D), ("size", _D)),
    "funding": _schema(("exchange", _S), ("symbol", _S), ("timestamp", _TS), ("funding_rate", _D), ("observed_at", _TS)),
}
KEYS = {
    "ohlcv": ("exchange", "symbol", "timeframe", "timestamp"),
    "orderbook": ("exchange", "symbol", "observed_at", "side", "level"),
    "funding": ("exchange", "symbol", "timestamp"),
}
GROUPS = ("exchange", "symbol", "timeframe")
PRICES = ("open", "high", "low", "close")
UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def interval_ms(interval: str) -> int:
    """Milliseconds of a fixed interval such as 4h; months do not exist."""
    found = re.fullmatch(r"([1-9]\d*)([smhdw])", interval)
    if not found:
        raise ValueError(f"unsupported interval: {interval!r}")
    return int(found[1]) * UNIT_MS[found[2]]


def empty_frame(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[kind])


def frame_from_rows(spark: SparkSession, kind: str, rows: list[dict]) -> DataFrame:
    """Strictly typed frame of dict rows; no rows give a typed empty frame."""
    schema = SCHEMAS[kind]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema, verifySchema=True)


def require_columns(df: DataFrame, needed) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def market_window() -> Window:
    """Rows of one market in time order; every time-series operator works in it."""
    return Window.partitionBy(*GROUPS).orderBy("timestamp")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def grid_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
