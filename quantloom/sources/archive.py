"""Monthly bar archives: checksummed ZIP files of CSV, read by Spark from any store and parsed in tasks."""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.schemas import interval_ms

FIELDS = 12
RAW = "path string, open_ms long, open double, high double, low double, close double, volume double"


def epoch_ms(value: int) -> int:
    """Milliseconds of an epoch in ms or us; microseconds must be whole milliseconds."""
    if 10**12 <= value < 10**15:
        return value
    if value >= 10**15 and value % 1000 == 0:
        return value // 1000
    raise ValueError(f"not an epoch in ms or us: {value}")


def parse_archive(content: bytes, digest: str | None) -> list[tuple]:
    """Rows (open_ms, open, high, low, close, volume) of one archive; a wrong checksum or shape raises."""
    if digest is not None and hashlib.sha256(content).hexdigest() != digest:
        raise ValueError("checksum mismatch")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if len(names) != 1:
            raise ValueError("an archive holds one file")
        rows = list(csv.reader(io.StringIO(z.read(names[0]).decode())))
    if any(len(r) != FIELDS for r in rows):
        raise ValueError(f"rows must have {FIELDS} fields")
    return [(epoch_ms(int(r[0])), *map(float, r[1:6])) for r in rows]


def read_archives(spark: SparkSession, path: str, symbol: str, interval: str, start: int, end: int, digests: dict[str, str] | None = None) -> DataFrame:
    """OHLCV bars of all archives under a path; any row outside [start, end) or off the interval's grid raises."""
    known = digests or {}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = parse_archive(content, known.get(name.rsplit("/", 1)[-1]))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["path", "open_ms", "open", "high", "low", "close", "volume"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(parse, RAW)
    wrong = (F.col("open_ms") < start) | (F.col("open_ms") >= end) | (F.pmod(F.col("open_ms") - start, F.lit(interval_ms(interval))) != 0)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("bar off its grid in "), "path"))).otherwise(F.timestamp_millis("open_ms"))
    stamp = checked.cast("timestamp")
    return raw.select(F.lit("archive").alias("exchange"), F.lit(symbol).alias("symbol"), F.lit(interval).alias("timeframe"), stamp.alias("timestamp"), "open", "high", "low", "close", "volume", F.current_timestamp().alias("observed_at"))


def months_between(start: int, end: int) -> list[str]:
    """yyyy-MM of the whole UTC months of [start, end) in epoch ms; a bound inside a month raises."""
    first, last = (datetime.fromtimestamp(t / 1000, UTC) for t in (start, end))
    if end <= start or any((t.day, t.hour, t.minute, t.second, t.microsecond) != (1, 0, 0, 0, 0) for t in (first, last)):
        raise ValueError("the range must be whole UTC months")
    count = (last.year - first.year) * 12 + last.month - first.month
    return [f"{first.year + (first.month - 1 + k) // 12}-{(first.month - 1 + k) % 12 + 1:02}" for k in range(count)]


def read_months(spark: SparkSession, path: str, symbol: str, interval: str, start: int, end: int, digests: dict[str, str] | None = None) -> DataFrame:
    """read_archives() of a range of whole months in order of time; a month without any bar raises."""
    wanted = months_between(start, end)
    bars = read_archives(spark, path, symbol, interval, start, end, digests)
    month = F.date_format(F.to_utc_timestamp("timestamp", spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM")
    missing = sorted(set(wanted) - {r[0] for r in bars.select(month).distinct().collect()})  # a row for each month
    if missing:
        raise ValueError(f"no bars in {', '.join(missing)}")
    return bars.orderBy("timestamp")
