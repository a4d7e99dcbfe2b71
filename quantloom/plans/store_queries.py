"""Queries of what keeps panels: content digests, segments of a stream, archives by month, merges in buckets, footers."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.digest import content_parts
from quantloom.operators import book, inventory, quality
from quantloom.operators.prepare import same_rows
from quantloom.plans import panel_queries, registry
from quantloom.plans.panel_queries import FEED_SQL, feed_log, observations, t_ms
from quantloom.plans.registry import query
from quantloom.schemas import SCHEMAS
from quantloom.sources.archive_source import archive_bars
from quantloom.sources.feed import read_log
from quantloom.sources.store import BucketedPanel, damaged_files, manifest, scratch_root, write_artifact, write_report
from quantloom.streaming.checkpoints import CheckpointSink

# JSON of a row by hand, as the engine writes it.
ORDER_JSON = "'{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}'"


@query(f"""WITH r AS (SELECT o_orderpriority, md5({ORDER_JSON}) AS d FROM orders UNION ALL SELECT o_orderpriority, md5({ORDER_JSON}) FROM orders WHERE o_orderkey % 1000 = 0)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS "rows", CAST(sum(CAST(('0x' || substr(d, 1, 15)) AS HUGEINT)) AS VARCHAR) AS low, CAST(sum(CAST(('0x' || substr(d, 16, 15)) AS HUGEINT)) AS VARCHAR) AS high FROM r GROUP BY 1""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the orders of each priority, some of which stand there twice."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.union(orders.where("o_orderkey % 1000 = 0"))
    parts = content_parts(rows, ["o_orderpriority"], ["o_orderkey", "o_custkey", "o_orderstatus"])
    return parts.select("o_orderpriority", "rows", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


@query("""SELECT event_type AS symbol, CAST(count(*) AS BIGINT) AS "rows", CAST(sum(event_id) AS BIGINT) AS ids, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us FROM events GROUP BY 1""")
def checkpoint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, written through the checkpoint sink, which gets every batch twice; what its segments hold."""
    root = scratch_root(spark, "segments")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").repartitionByRange(6, "ts").write.parquet(f"{root}/given")
    schema = "event_id long, ts timestamp, event_type string"
    sink = CheckpointSink(spark, f"{root}/sink", schema)

    def twice(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        sink(batch, number)

    flow = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/given").writeStream.foreachBatch(twice)
    flow.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    sink.publish()
    return sink.read().groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"), F.min(F.unix_micros("ts")).alias("first_us"))


ARCHIVE_SYMBOL = "1-URGENT"
ARCHIVE_START, ARCHIVE_END = 1_104_537_600_000, 1_199_145_600_000  # 2005 to 2007
#: Orders are dated some 3,652 days later, since archives know no times before 2001.
ARCHIVE_SHIFT = 315_532_800_000


def zipped(rows: pd.DataFrame) -> bytes:
    """One month's bars as an archive."""
    text = "".join(f"{at},{o!r},{h!r},{lo!r},{c!r},{v!r},0,0,0,0,0,0\n" for at, o, h, lo, c, v in rows.itertuples(index=False))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bars.csv", text)
    return out.getvalue()


def write_archives(bars: DataFrame, root: str) -> None:
    """Archives <symbol>-1d-<month>.zip and their checksums of bars (symbol, at, open, high, low, close, volume), a month in a task."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        content = zipped(rows.sort_values("at")[["at", "open", "high", "low", "close", "volume"]])
        name = f"{folder}/{key[0]}-1d-{key[1]}.zip"
        for path, data in ((name, content), (f"{name}.CHECKSUM", f"{hashlib.sha256(content).hexdigest()}  {key[0]}-1d-{key[1]}.zip\n".encode())):
            with store.open_output_stream(path) as out:
                out.write(data)
        return pd.DataFrame({"path": [name]})

    month = F.date_format(F.timestamp_millis("at"), "yyyy-MM")
    bars.withColumn("month", month).groupBy("symbol", "month").applyInPandas(write, "path string").write.mode("overwrite").parquet(f"{root}.paths")


@query(f"""WITH b AS (SELECT epoch_ms(o_orderdate) + {ARCHIVE_SHIFT} AS t_ms, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders WHERE o_orderpriority = '{ARCHIVE_SYMBOL}' AND epoch_ms(o_orderdate) % 86400000 = 0 GROUP BY 1)
SELECT t_ms, open, high, low, close, volume FROM b WHERE t_ms >= {ARCHIVE_START} AND t_ms < {ARCHIVE_END} AND t_ms >= epoch_ms(TIMESTAMP '2006-03-10') AND t_ms < epoch_ms(TIMESTAMP '2007-07-01')""")
def archive_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the urgent orders, written as monthly archives and read by the archive source over some of the months."""
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + ARCHIVE_SHIFT
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where((F.col("o_orderpriority") == ARCHIVE_SYMBOL) & (at % 86_400_000 == 0))
    bars = rows.groupBy(F.col("o_orderpriority").alias("symbol"), at.alias("at")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))
    root = scratch_root(spark, "archives")
    write_archives(bars, root)
    out = archive_bars(spark, root, ARCHIVE_SYMBOL, "1d", ARCHIVE_START, ARCHIVE_END)
    out = out.where((F.col("timestamp") >= F.to_timestamp(F.lit("2006-03-10"))) & (F.col("timestamp") < F.to_timestamp(F.lit("2007-07-01"))))
    return out.select(t_ms(), "open", "high", "low", "close", "volume")


@query("""WITH r AS (SELECT event_type AS symbol, epoch_ms(ts) - epoch_ms(ts) % 3600000 AS t_ms, value AS close, event_id % 3 > 0 AS batch, ts FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, t_ms ORDER BY ts DESC, batch DESC) AS k FROM r)
SELECT symbol, t_ms, close FROM k WHERE k = 1""")
def bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyed_merge on a panel in buckets, whose old rows a merge does not move."""
    columns, rows = SCHEMAS["ohlcv"].fieldNames(), observations(spark, sf_dir)
    panel = BucketedPanel(spark, "ohlcv", scratch_root(spark, "buckets"), 8)
    panel.write(rows.where("event_id % 3 = 0").select(*columns))
    return panel.merged(rows.where("event_id % 3 > 0").select(*columns)).select("symbol", t_ms(), "close")


@query("""SELECT CAST(count(*) AS BIGINT) AS "rows", min(l_orderkey) AS least_l_orderkey, max(l_orderkey) AS most_l_orderkey, min(l_extendedprice) AS least_l_extendedprice, max(l_extendedprice) AS most_l_extendedprice FROM lineitem""")
def footer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.footer_inventory(spark, f"{sf_dir}/lineitem.parquet", ("l_orderkey", "l_extendedprice"))


@query(f"""WITH {FEED_SQL} SELECT CAST(source AS VARCHAR) AS source, CAST(epoch AS BIGINT) AS epoch, CAST(count(*) AS BIGINT) AS messages, CAST(1 AS BIGINT) AS snapshots,
  CAST(count(*) FILTER (WHERE k > 1 AND NOT broken AND NOT crossed) AS BIGINT) AS updates, CAST(0 AS BIGINT) AS heartbeats, CAST(count(*) FILTER (WHERE broken OR crossed) AS BIGINT) AS errors FROM fe GROUP BY source, epoch""")
def feed_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every connection of the feed logs held."""
    counts = book.session_counts(feed_log(spark, sf_dir).where("source is not null"))
    return counts.where("epoch > 0 and messages > 0")


@query(f"""WITH {FEED_SQL}, c AS (SELECT source, epoch, count(k) AS messages, count(*) FILTER (WHERE broken OR crossed) AS errors FROM (SELECT source, epoch, k, broken, crossed FROM fe UNION ALL SELECT source, epoch, NULL, NULL, NULL FROM ep WHERE event = 'connection_start') GROUP BY 1, 2)
SELECT CAST(source AS VARCHAR) AS source, CAST(count(*) AS BIGINT) AS connections, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(messages) > 0 AND sum(errors) = 0 AND count(*) = 1 AS INTEGER) AS ok FROM c WHERE source IS NOT NULL GROUP BY source""")
def feed_session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's session is good."""
    counts = book.session_counts(feed_log(spark, sf_dir).where("source is not null"))
    return book.session_verdict(counts).withColumn("ok", F.col("ok").cast("int"))


# Accepted updates of the feed logs with the levels that stand after them; no update removes a level.
BOOK_SQL = f"""{FEED_SQL}, ac AS (SELECT source, epoch, line, k, line % 40 + 101 AS price, line % 5 + 1 AS size, row_number() OVER (PARTITION BY source, epoch ORDER BY line) AS n FROM fe WHERE k > 1 AND NOT broken AND NOT crossed),
lv AS (SELECT source, epoch, price, arg_max(size, line) AS size FROM ac GROUP BY 1, 2, 3 UNION ALL SELECT source, epoch, 100, 1 FROM fe WHERE k = 1)"""


@query(f"""WITH {BOOK_SQL} SELECT CAST(source AS VARCHAR) AS source, CAST(epoch AS BIGINT) AS epoch,
  sha256('[' || string_agg('["bid", "' || price || '", "' || size || '"]', ', ' ORDER BY price) || ', ["ask", "200", "1"]]') AS digest FROM lv GROUP BY source, epoch""")
def feed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each connection's book at its end."""
    states = book.final_states(feed_log(spark, sf_dir).where("source is not null"))
    return states.where("epoch > 0 and ready").select("source", "epoch", "digest")


@query(f"""WITH {BOOK_SQL}, mx AS (SELECT *, max(price) OVER (PARTITION BY source, epoch ORDER BY line ROWS UNBOUNDED PRECEDING) AS best FROM ac),
ck AS (SELECT mx.source, mx.epoch, mx.line, mx.n AS updates, mx.best AS price, la.size FROM mx ASOF JOIN ac AS la ON la.source = mx.source AND la.epoch = mx.epoch AND la.price = mx.best AND mx.line >= la.line WHERE mx.n % 3 = 0
  UNION ALL SELECT source, epoch, line, 0, 100, 1 FROM fe WHERE k = 1)
SELECT CAST(source AS VARCHAR) AS source, CAST(epoch AS BIGINT) AS epoch, line, CAST(updates AS BIGINT) AS updates, CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size FROM ck""")
def feed_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best bid after each snapshot and each third update."""
    rows = book.replay(feed_log(spark, sf_dir).where("source is not null"), depth=1, every=3).where("side = 'bid' and epoch > 0")
    return rows.select("source", "epoch", "line", "updates", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))


HEARTBEAT_SQL = f"""{FEED_SQL}, hb AS (SELECT *, min(CASE WHEN k > 1 AND line % 19 = 0 THEN k END) OVER (PARTITION BY source, epoch) AS torn FROM fe)"""


@query(f"""WITH {HEARTBEAT_SQL} SELECT CAST(source AS VARCHAR) AS source, CAST(epoch AS BIGINT) AS epoch, CAST(count(*) FILTER (WHERE torn IS NULL OR k < torn) AS BIGINT) AS heartbeats, CAST(count(*) FILTER (WHERE k >= torn) AS BIGINT) AS errors FROM hb GROUP BY source, epoch""")
def feed_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats of every connection, numbered in order; after a number that is wrong none counts."""
    rows = feed_log(spark, sf_dir).where("source is not null")
    order = Window.partitionBy("source", "_epoch").orderBy("line")
    rows = book.with_epoch(rows).withColumnRenamed("epoch", "_epoch")
    n = F.sum((F.col("event") == "message").cast("long")).over(order) - 1
    rows = rows.withColumn("_n", n)
    beat = F.when((F.col("_n") > 0) & (F.col("line") % 19 == 0), F.lit(0)).otherwise(F.col("_n"))
    text = F.to_json(F.struct(F.lit("heartbeats").alias("channel"), F.col("_n").alias("sequence_num"), F.array(F.struct(beat.alias("heartbeat_counter"))).alias("events")))
    counts = book.session_counts(rows.select("source", "line", "event", F.when(F.col("event") == "message", text).alias("raw_text")))
    return counts.where("epoch > 0 and messages > 0").select("source", "epoch", "heartbeats", "errors")


@query(f"""WITH {FEED_SQL} SELECT CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE k > 1 AND NOT broken AND NOT crossed) AS BIGINT) AS updates, CAST(count(*) FILTER (WHERE broken OR crossed) AS BIGINT) AS errors, CAST((SELECT count(*) FROM l WHERE source IS NOT NULL AND event = 'connection_start') AS BIGINT) AS connections FROM fe""")
def feed_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed logs written as JSON lines, many sources in a file, read back and replayed."""
    root = scratch_root(spark, "logs")
    log = feed_log(spark, sf_dir).where("source is not null")
    lines = log.select(F.col("source").cast("string").alias("source"), F.to_json(F.struct("line", "event", F.col("source").cast("string").alias("connection_id"), "raw_text")).alias("value"))
    lines.repartition("source").select("value").write.text(root)
    read = read_log(spark, root).withColumn("source", F.col("connection_id"))
    counts = book.session_counts(read)
    return counts.where("epoch > 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "updates", "errors")), F.count("*").alias("connections"))


MANIFEST_REQUEST = {"months": [1, 2], "table": "orders"}


@query(f"""WITH r AS (SELECT md5({ORDER_JSON}) AS d FROM orders),
p AS (SELECT count(*) AS n, sum(CAST(('0x' || substr(d, 1, 15)) AS HUGEINT)) AS low, sum(CAST(('0x' || substr(d, 16, 15)) AS HUGEINT)) AS high FROM r)
SELECT CAST(n AS BIGINT) AS "rows", sha256('o_custkey bigint|o_orderkey bigint|o_orderstatus string|' || n || '|' || low || '|' || high) AS content_sha256, sha256('{json.dumps(MANIFEST_REQUEST, sort_keys=True)}') AS request_sha256, CAST(0 AS BIGINT) AS damaged FROM p""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders written twice as one artifact, what its manifest says and how many of its files changed since."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    root = scratch_root(spark, "artifacts")
    path = write_artifact(rows, root, "orders", MANIFEST_REQUEST)
    assert write_artifact(rows.repartition(3), root, "orders", MANIFEST_REQUEST) == path
    told = manifest(spark, path)
    one = spark.createDataFrame([(told["rows"], told["content_sha256"], told["request_sha256"])], "rows long, content_sha256 string, request_sha256 string")
    return one.crossJoin(damaged_files(spark, path).agg(F.count("*").alias("damaged")))  # one row each


def _issues(*metrics: str) -> str:
    cases = ", ".join(f"CASE WHEN {m} > 0 THEN '{m}:' || {m} END" for m in metrics)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


@query(f"""SELECT 'orderbook' AS kind, "rows", {_issues('null_values', 'duplicate_rows', 'invalid_levels', 'crossed_snapshots')} AS issues FROM ({registry.ORACLE['book_assessment']})
UNION ALL SELECT 'funding', "rows", {_issues('null_values', 'duplicate_rows', 'invalid_rates')} FROM ({registry.ORACLE['funding_quality']})""")
def quality_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of two kinds of tables, each written as a JSON report and read back."""
    root, out = scratch_root(spark, "reports"), []
    for kind, rows in (("orderbook", panel_queries.book_rows(spark, sf_dir)), ("funding", panel_queries.funding_rows(spark, sf_dir))):
        write_report(quality.assess(kind, rows), f"{root}/{kind}")
        out.append(spark.read.json(f"{root}/{kind}").select(F.lit(kind).alias("kind"), "rows", "issues"))
    return out[0].union(out[1])


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE o_orderkey % 500 = 0), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 700 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM a)
SELECT 'same' AS case_name, 1 AS equal UNION ALL SELECT 'repeated', CAST((SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS INTEGER) UNION ALL SELECT 'changed', CAST((SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c)) = 0 AS INTEGER)""")
def frame_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the orders equal themselves in another order, with rows repeated, and with values lost."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    cases = {"same": rows.repartition(5).select("o_orderstatus", "o_orderkey"), "repeated": rows.union(rows.where("o_orderkey % 500 = 0")), "changed": rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 700 != 0, F.col("o_orderstatus")))}
    return spark.createDataFrame([(name, int(same_rows(rows, other))) for name, other in cases.items()], "case_name string, equal int")
