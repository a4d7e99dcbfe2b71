"""Monthly bar archives as a Spark data source: a partition for each month, months outside a time filter are not opened."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from quantloom.schemas import interval_ms
from quantloom.sources.archive import months_between, parse_archive

FORMAT = "bar_archives"
SCHEMA = "exchange string, symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double, observed_at timestamp"


def month_ms(month: str) -> tuple[int, int]:
    """[start, end) of yyyy-MM in epoch ms."""
    year, number = map(int, month.split("-"))
    after = (year + number // 12, number % 12 + 1)
    return tuple(int(datetime(y, m, 1, tzinfo=UTC).timestamp() * 1000) for y, m in ((year, number), after))


class Month(InputPartition):
    def __init__(self, month: str, path: str):
        self.month, self.path = month, path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        start, end = int(options["start"]), int(options["end"])
        self.months = months_between(start, end)
        now = datetime.fromisoformat(options["now"]) if "now" in options else datetime.now(UTC)
        if self.months[-1] >= now.strftime("%Y-%m"):
            raise ValueError(f"{self.months[-1]} is not over: its archive is not final")
        self.low, self.high = start, end

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the timestamp narrow the months; Spark filters the rows themselves."""
        for f in filters:
            if getattr(f, "attribute", None) == ("timestamp",) and isinstance(getattr(f, "value", None), datetime):
                at = f.value if f.value.tzinfo else f.value.astimezone()
                ms = int(at.timestamp() * 1000)
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, ms)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(self.high, ms + 1)
            yield f

    def partitions(self) -> list[Month]:
        o = self.options
        wanted = [m for m in self.months if month_ms(m)[1] > self.low and month_ms(m)[0] < self.high]
        return [Month(m, f"{o['path'].rstrip('/')}/{o['symbol']}-{o['interval']}-{m}.zip") for m in wanted] or [Month("", "")]

    def read(self, partition: Month) -> Iterator[tuple]:
        """Bars of a month, parsed in the task that opens its file. With a file of its SHA-256 beside it the content must fit."""
        from pyarrow import fs

        if not partition.month:
            return
        store, name = fs.FileSystem.from_uri(partition.path)
        content = store.open_input_file(name).readall()
        beside = f"{name}.CHECKSUM"
        digest = store.open_input_file(beside).readall().decode().split()[0].lower() if store.get_file_info(beside).type == fs.FileType.File else None
        seen = store.get_file_info(name).mtime or datetime.now(UTC)
        (start, end), step, n = month_ms(partition.month), interval_ms(self.options["interval"]), 0
        for at, *values in parse_archive(content, digest):
            if not start <= at < end or at % step:
                raise ValueError(f"a bar is outside {partition.month} or off its grid")
            n += 1
            yield "archive", self.options["symbol"], self.options["interval"], datetime.fromtimestamp(at / 1000, UTC), *values, seen
        if not n:
            raise ValueError(f"no bars in {partition.month}")


class ArchiveSource(DataSource):
    """Options: path, symbol, interval, start and end (whole UTC months, epoch ms); now for tests."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_bars(spark: SparkSession, path: str, symbol: str, interval: str, start: int, end: int, **more: str) -> DataFrame:
    """OHLCV bars of the archives <symbol>-<interval>-<month>.zip of whole months; the current month is refused."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    options = {"path": path, "symbol": symbol, "interval": interval, "start": str(start), "end": str(end), **more}
    return spark.read.format(FORMAT).options(**options).load()
