"""A sink of bounded, immutable segments for the rows of a stream: every batch counts once, however often it is handed over."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a segment at least, but for the last one of a stream.
SEGMENT_ROWS = 4_000


class CheckpointSink:
    """For writeStream.foreachBatch. A batch is written to a folder of its own number; once the batches that are in no segment
    have SEGMENT_ROWS rows together, they become a segment, which counts from the moment its log entry has its name. A batch
    that comes again is written over before that, and passed over after it. Readers see only logged segments.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, segment_rows: int = SEGMENT_ROWS):
        self.spark, self.root, self.schema, self.rows = spark, root.rstrip("/"), schema, segment_rows
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("pending", "segments", "log"):
            self._store.mkdirs(self._path(f"{self.root}/{name}"))

    def entries(self) -> list[dict]:
        """The log in order: first and last batch, rows and files of each segment."""
        found = self.spark.read.text(f"{self.root}/log/*.json").collect() if self._names("log", ".json") else []
        return sorted((json.loads(r[0]) for r in found), key=lambda e: e["first"])

    def _names(self, folder: str, end: str = "") -> list[str]:
        names = [s.getPath().getName() for s in self._store.listStatus(self._path(f"{self.root}/{folder}"))]
        return sorted(n for n in names if n.endswith(end) and not n.startswith((".", "_")))

    def _done(self) -> int:
        """The last batch that is in a segment; log entries are named by it."""
        names = self._names("log", ".json")
        return int(names[-1].removesuffix(".json")) if names else -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self._done():
            return
        batch.write.mode("overwrite").parquet(f"{self.root}/pending/{number:012}")
        self.publish(self.rows)

    def publish(self, least: int = 1) -> bool:
        """Make a segment of what is pending, if it has so many rows; returns whether it did."""
        done = self._done()
        waiting = [n for n in self._names("pending") if int(n) > done]
        if not waiting:
            return False
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/pending/{n}" for n in waiting))
        n = rows.count()
        if n < least:
            return False
        first, last = int(waiting[0]), int(waiting[-1])
        path = f"{self.root}/segments/{first:012}-{last:012}"
        rows.repartition(max(1, n // (2 * self.rows))).write.mode("overwrite").option("compression", "zstd").parquet(path)
        entry, name = json.dumps({"first": first, "last": last, "rows": n, "path": path}), f"{self.root}/log/{last:012}.json"
        out = self._store.create(self._path(f"{name}.tmp"), True)
        out.write(bytearray(entry.encode()))
        out.close()
        self._store.rename(self._path(f"{name}.tmp"), self._path(name))
        for batch in waiting:
            self._store.delete(self._path(f"{self.root}/pending/{batch}"), True)
        return True

    def read(self) -> DataFrame:
        """The rows of all segments, with the segment's first batch."""
        entries = self.entries()
        if not entries:
            return self.spark.createDataFrame([], self.schema).withColumn("segment", F.lit(None).cast("long"))
        rows = self.spark.read.schema(self.schema).parquet(*(e["path"] for e in entries))
        return rows.withColumn("segment", F.regexp_extract("_metadata.file_path", r"/(\d{12})-\d{12}/[^/]*$", 1).cast("long"))
