"""Panel store: Parquet partitioned by market, keyed merges into new versions, write-once datasets with manifests."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quantloom.functions.digest import content_digest
from quantloom.operators.prepare import keep_last_observed, keyed_merge
from quantloom.schemas import KEYS, SCHEMAS, empty_frame, require_columns

PARTS = {"ohlcv": ["exchange", "symbol", "timeframe"], "orderbook": ["exchange", "symbol"], "funding": ["exchange", "symbol"]}


def scratch_root(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; without that setting a local session gets one of its own, a cluster raises."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-store-", dir="/tmp")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """frame as a table in the shared folder, so that what follows reads it instead of computing it again."""
    path = scratch_root(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def versioned(kind: str) -> StructType:
    return StructType([*SCHEMAS[kind].fields, StructField("_v", StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _text(spark: SparkSession, path: str, value: str | None = None) -> str | None:
    """Read a small text of the store, or write it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if value is None:
        return None if not system.exists(where) else "\n".join(r[0] for r in spark.read.text(path).collect())
    out = system.create(where, True)
    out.write(bytearray(value.encode()))
    out.close()
    return value


class PanelStore:
    """A root with one folder for each kind, partitioned by market and version; CURRENT names the list of the versions that
    readers see, one of each market. A write merges by key into new versions of the markets it has rows of, and then moves
    CURRENT: other markets are not touched, readers never see half a merge, nothing is overwritten while it is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self, kind: str) -> DataFrame | None:
        """The market columns and _v of each market, or None."""
        path = _text(self.spark, f"{self.root}/{kind}/CURRENT")
        return self.spark.read.schema(", ".join(f"{c} string" for c in (*PARTS[kind], "_v"))).parquet(path) if path else None

    def _rows(self, kind: str, versions: DataFrame) -> DataFrame:
        """All rows of some markets' versions; the join prunes the other partitions."""
        rows = self.spark.read.schema(versioned(kind)).parquet(f"{self.root}/{kind}/markets")
        return rows.join(versions, [*PARTS[kind], "_v"]).select(*SCHEMAS[kind].fieldNames())  # Spark broadcasts a list of a proven size

    def write(self, kind: str, frame: DataFrame) -> str:
        require_columns(frame, SCHEMAS[kind].fieldNames())
        name, home = uuid.uuid4().hex[:12], f"{self.root}/{kind}"
        touched, old = frame.select(*PARTS[kind]).distinct(), self.current(kind)
        before = self._rows(kind, old.join(touched, PARTS[kind], "left_semi")) if old is not None else empty_frame(self.spark, kind)
        merged = keyed_merge(before, frame, kind)
        merged.withColumn("_v", F.lit(name)).write.mode("append").partitionBy(*PARTS[kind], "_v").option("compression", "zstd").parquet(f"{home}/markets")
        versions = touched.withColumn("_v", F.lit(name))
        if old is not None:
            versions = versions.unionByName(old.join(touched, PARTS[kind], "left_anti"))
        versions.write.parquet(f"{home}/versions/{name}")
        return _text(self.spark, f"{home}/CURRENT", f"{home}/versions/{name}")

    def vacuum(self, kind: str) -> int:
        """Delete the versions that CURRENT does not name; returns how many. No reader of an older list may be left."""
        home, spark = f"{self.root}/{kind}", self.spark
        if self.current(kind) is None:
            return 0
        every = spark.read.schema(versioned(kind)).parquet(f"{home}/markets").select(*PARTS[kind], "_v", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
        gone = every.join(self.current(kind), [*PARTS[kind], "_v"], "left_anti").select("folder").collect()  # a row for each old version
        for row in gone:
            where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row.folder))
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(gone)

    def read(self, kind: str, start: int | None = None, end: int | None = None, **market: str) -> DataFrame:
        """Rows of [start, end) in epoch ms of a market; partitions and row groups are pruned. No data: a typed empty frame."""
        versions = self.current(kind)
        if versions is None:
            return empty_frame(self.spark, kind)
        for name, value in market.items():
            versions = versions.where(F.col(name) == value)
        rows = self._rows(kind, versions)
        for name, value in market.items():
            rows = rows.where(F.col(name) == value)
        time = "observed_at" if kind == "orderbook" else "timestamp"
        if start is not None:
            rows = rows.where(F.col(time) >= F.timestamp_millis(F.lit(start)))
        if end is not None:
            rows = rows.where(F.col(time) < F.timestamp_millis(F.lit(end)))
        return rows


def write_once(frame: DataFrame, path: str, request: dict) -> None:
    """Write a dataset, a table of its files' SHA-256 (path.files) and its manifest; if it is there already, it must have the
    same rows. Rows are compared by their content digest: one pass over the new rows, none over the old."""
    spark, digest = frame.sparkSession, content_digest(frame)
    try:
        frame.write.mode("errorifexists").parquet(path)
    except AnalysisException:
        told = _text(spark, f"{path}.manifest.json")
        had = json.loads(told)["content_sha256"] if told else content_digest(spark.read.parquet(path))
        if had != digest:
            raise ValueError(f"{path} exists with other rows") from None
        return
    name = F.regexp_extract("path", "[^/]*$", 0)
    file_digests(spark, f"{path}/*.parquet").select(name.alias("file"), "length", "sha256").write.mode("overwrite").parquet(f"{path}.files")
    files = spark.read.parquet(f"{path}.files")
    text = json.dumps(request, sort_keys=True)
    manifest = {
        "captured_at_utc": datetime.now(UTC).isoformat(), "content_sha256": digest, "files": files.count(), "files_sha256": content_digest(files), "rows": spark.read.parquet(path).count(),
        "request": request, "request_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }
    _text(spark, f"{path}.manifest.json", json.dumps(manifest, sort_keys=True))


def manifest(spark: SparkSession, path: str) -> dict:
    """What write_once noted of a dataset."""
    return json.loads(_text(spark, f"{path}.manifest.json"))


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """file, problem of the files of a dataset of write_once that changed, went or came since."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    now = file_digests(spark, f"{path}/*.parquet").select(name.alias("file"), F.col("sha256").alias("now"))
    both = spark.read.parquet(f"{path}.files").join(now, "file", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def write_artifact(frame: DataFrame, root: str, name: str, request: dict) -> str:
    """Write a dataset under a name that its request and its content give, unless it is there; returns its path. The same
    request with other content raises."""
    spark, asked = frame.sparkSession, hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()[:12]
    path = f"{root.rstrip('/')}/{name}-{asked}"
    write_once(frame, path, request)
    digest = manifest(spark, path)["content_sha256"]
    _text(spark, f"{path}.name", f"{name}-{asked}-{digest[:12]}")
    return path


def write_report(frame: DataFrame, path: str) -> None:
    """A small report, such as a quality verdict, as one JSON document for each row."""
    frame.coalesce(1).write.mode("errorifexists").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of the files under a path, hashed by the tasks that read them."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


class BucketedPanel:
    """A panel in buckets of its keys: a merge deals out only the batch, old rows stay where they are.

    The table lies in a folder of the shared store, a version for each merge; a version counts once its table exists, and the
    one before goes then. Keys are not null.
    """

    def __init__(self, spark: SparkSession, kind: str, root: str, buckets: int = 64):
        self.spark, self.kind, self.root, self.buckets = spark, kind, root.rstrip("/"), buckets
        self.keys, self.name, self.version = list(KEYS[kind]), f"panel_{uuid.uuid4().hex[:12]}", 0

    def table(self) -> DataFrame | None:
        return self.spark.table(f"{self.name}_{self.version}") if self.version else None

    def merged(self, batch: DataFrame) -> DataFrame:
        """The old rows and the batch's, the last observed of each key; equal times: the batch's."""
        columns = SCHEMAS[self.kind].fieldNames()
        new, old = keep_last_observed(batch.select(*columns), self.kind), self.table()
        if old is None:
            return new
        rest = [c for c in columns if c not in self.keys]
        left = old.select(*self.keys, F.struct(*rest).alias("_old"))
        right = new.select(*self.keys, F.struct(*rest).alias("_new"))
        both = left.join(right.hint("merge"), self.keys, "full")
        later = F.col("_old").isNull() | (F.col("_new.observed_at") >= F.col("_old.observed_at")) | (F.col("_new").isNotNull() & F.col("_old.observed_at").isNull())
        row = F.when(later & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.coalesce("_old", "_new"))
        return both.select(*self.keys, row.alias("_row")).select(*self.keys, "_row.*").select(*columns)

    def write(self, batch: DataFrame) -> None:
        require_columns(batch, SCHEMAS[self.kind].fieldNames())
        before = self.version
        rows = self.merged(batch)
        if not before:
            rows = rows.repartition(self.buckets, *self.keys)
        name = f"{self.name}_{before + 1}"
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(name)
        self.version = before + 1
        if before:
            self.drop(before)

    def drop(self, version: int | None = None) -> None:
        name = f"{self.name}_{version or self.version}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
