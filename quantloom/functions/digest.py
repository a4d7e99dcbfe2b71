"""Digests of a table's content that depend on neither the order of its rows nor their partitions.

A row's digest is the MD5 of its columns, by name, as JSON; a table's digest sums its rows' digests in two lanes and counts
them, so equal rows count as often as they stand there. Parts have digests that add up to that of the whole, and one pass
of a map-side combined aggregation finds it, where comparing two tables row by row shuffles both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a lane: sums of 2**60 rows stay exact in 38 decimal digits.
LANE = 15


def row_digest(columns: Sequence[str]) -> Column:
    """MD5 of the row as JSON of its columns in order of name, nulls included. -0.0 is not 0.0; all NaNs are equal."""
    told = F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.md5(told.cast("binary"))


def lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + LANE * k, LANE), 16, 10).cast("decimal(38,0)") for k in range(2)]


def content_parts(frame: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """keys, rows, low, high: the digest of each key's rows (of all rows without keys); parts of one table add up."""
    one, two = lanes(F.col("_digest"))
    rows = frame.select(*keys, row_digest(columns or frame.columns).alias("_digest"))
    zero = F.lit(0).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.coalesce(F.sum(one), zero).alias("low"), F.coalesce(F.sum(two), zero).alias("high"))


def added(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parts (rows, low, high) of the same keys as one."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("rows", "low", "high")))


def content_digest(frame: DataFrame) -> str:
    """One name for a table's columns, types and rows."""
    found = content_parts(frame).first()
    kinds = "|".join(f"{n} {t}" for n, t in sorted(frame.dtypes))
    return hashlib.sha256(f"{kinds}|{found.rows}|{found.low}|{found.high}".encode()).hexdigest()
