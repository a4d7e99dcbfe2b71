"""Content digests, artifacts, segments of streams, archives by month, merges in buckets, footers, metrics, stream states."""

import io
import json
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quantloom.functions.digest import added, content_digest, content_parts
from quantloom.operators import book, monitor, risk, stats
from quantloom.schemas import SCHEMAS

MONTH = {m: int(datetime(2024, m, 1, tzinfo=UTC).timestamp() * 1000) for m in range(1, 13)}


def test_content_digest(spark):
    rows = [(k, None if k % 5 == 0 else f"t{k % 7}", k / 3, [k, None]) for k in range(200)]
    df = spark.createDataFrame(rows, "a long, b string, c double, d array<long>")
    one = content_digest(df)
    assert one == content_digest(df.repartition(7)) == content_digest(df.orderBy(F.desc("a")).select("d", "c", "b", "a"))
    assert len({one, content_digest(df.union(df.limit(1))), content_digest(df.where("a > 0")), content_digest(df.withColumn("a", F.col("a").cast("int")))}) == 4
    shift = spark.createDataFrame([(None, "x"), ("y", None)], "p string, q string")
    moved = spark.createDataFrame([("x", None), (None, "y")], "p string, q string")
    assert content_digest(shift) != content_digest(moved)
    parts = content_parts(df.where("a < 90")).union(content_parts(df.where("a >= 90")))
    assert added(parts).first() == content_parts(df).first()
    assert content_parts(df.where("false")).first().rows == 0


def test_artifacts_and_damaged_files(spark, tmp_path):
    from quantloom.sources.store import damaged_files, write_artifact, write_once, write_report

    df = spark.range(50).withColumn("x", F.col("id") * 2)
    path = write_artifact(df, f"file://{tmp_path}/art", "factors", {"w": [6, 12]})
    assert write_artifact(df.repartition(3), f"file://{tmp_path}/art", "factors", {"w": [6, 12]}) == path
    assert write_artifact(df, f"file://{tmp_path}/art", "factors", {"w": [6]}) != path
    with pytest.raises(ValueError):
        write_artifact(df.where("id > 0"), f"file://{tmp_path}/art", "factors", {"w": [6, 12]})
    local = path.removeprefix("file://")
    manifest = json.loads(open(f"{local}.manifest.json").read())
    assert manifest["rows"] == 50 and manifest["content_sha256"] == content_digest(df)
    assert damaged_files(spark, path).count() == 0
    from pathlib import Path

    some = sorted(Path(local).glob("*.parquet"))
    (some[0].parent / f".{some[0].name}.crc").unlink()
    some[0].write_bytes(some[0].read_bytes() + b"x")
    assert [r.problem for r in damaged_files(spark, path).collect()] == ["changed"]
    write_report(spark.createDataFrame([(1, True)], "rows long, ok boolean"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first().rows == 1
    write_once(df, f"file://{tmp_path}/once", {})
    with pytest.raises(ValueError):
        write_once(df.union(df.limit(1)), f"file://{tmp_path}/once", {})


def test_segments_count_each_batch_once(spark, tmp_path):
    from quantloom.streaming.checkpoints import CheckpointSink

    root, schema = f"file://{tmp_path}/sink", "id long, v string"
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("x").alias("v"))
    sink = CheckpointSink(spark, root, schema, 100)
    assert sink.read().count() == 0 and not sink.publish()
    sink(rows(0, 40), 0)
    assert sink.read().count() == 0
    sink(rows(0, 40), 0)  # again, before it is in a segment
    sink(rows(40, 120), 1)
    assert [(e["first"], e["last"], e["rows"]) for e in sink.entries()] == [(0, 1, 120)]
    for number in (0, 1):  # again, after it
        CheckpointSink(spark, root, schema, 100)(rows(0, 40), number)
    assert sink.read().count() == 120 and sink.read().select("id").distinct().count() == 120
    sink(rows(120, 1000), 2)
    files = sink.read().where("segment = 2").groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in files) == 880 and min(r["count"] for r in files) >= 100
    sink(rows(1000, 1010), 3)
    again = CheckpointSink(spark, root, schema, 100)  # a driver that starts anew
    assert again.publish() and not again.publish() and again.read().count() == 1010
    assert not (tmp_path / "sink/pending").glob("0*") or not list((tmp_path / "sink/pending").glob("0*"))


def zipped(bars):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.csv", "".join(f"{t},1,2,0.5,1.5,10,0,0,0,0,0,0\n" for t in bars))
    return out.getvalue()


def test_a_month_filter_opens_one_file(spark, tmp_path):
    from quantloom.sources.archive_source import archive_bars

    day = 86_400_000
    for m in range(1, 6):
        (tmp_path / f"A-1d-2024-{m:02}.zip").write_bytes(zipped(range(MONTH[m], MONTH[m + 1], day)) if m == 3 else b"not an archive")
    read = lambda a, b, **more: archive_bars(spark, f"file://{tmp_path}", "A", "1d", MONTH[a], MONTH[b], **more)
    march = read(1, 6).where((F.col("timestamp") >= F.to_timestamp(F.lit("2024-03-05"))) & (F.col("timestamp") < F.to_timestamp(F.lit("2024-03-20"))))
    assert march.count() == 15  # the other files cannot be read
    assert march.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="not a zip|BadZip|zip"):
        read(1, 6).count()
    assert read(3, 4).count() == 31 and read(3, 4).where("close > 2").count() == 0
    for now, ok in (("2024-04-01T00:00:00+00:00", True), ("2024-03-31T23:59:59+00:00", False)):
        if ok:
            assert read(3, 4, now=now).count() == 31
        else:
            with pytest.raises(Exception, match="not over"):
                read(3, 4, now=now).count()
    (tmp_path / "A-1d-2024-03.zip.CHECKSUM").write_text("0" * 64 + "  A-1d-2024-03.zip\n")
    with pytest.raises(Exception, match="checksum"):
        read(3, 4).count()
    (tmp_path / "A-1d-2024-03.zip.CHECKSUM").unlink()
    (tmp_path / "A-1d-2024-03.zip").write_bytes(zipped([MONTH[4]]))
    with pytest.raises(Exception, match="outside"):
        read(3, 4).count()


def panel(spark, rows):
    full = [("x", s, "1h", datetime.fromtimestamp(t * 3600, UTC), p, p, p, p, 1.0, datetime.fromtimestamp(o, UTC)) for s, t, p, o in rows]
    return spark.createDataFrame(full, SCHEMAS["ohlcv"])


def test_a_merge_in_buckets_does_not_move_old_rows(spark, tmp_path):
    from quantloom.sources.store import BucketedPanel

    one = BucketedPanel(spark, "ohlcv", f"file://{tmp_path}/buckets", 4)
    one.write(panel(spark, [("a", t, 1.0, 100) for t in range(50)] + [("b", t, 2.0, 100) for t in range(50)]))
    batch = panel(spark, [("a", 3, 5.0, 100), ("a", 4, 6.0, 99), ("a", 5, 7.0, 101), ("a", 5, 8.0, 102), ("c", 1, 9.0, 1)])
    rows = one.merged(batch)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # to settle the batch's own keys, and to deal it out
    old = plan[plan.index(f"{one.name}_1") - 2000 : plan.index(f"{one.name}_1")]
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, plan
    assert "Exchange" not in old.rsplit("SortMergeJoin", 1)[-1].split("+- ", 2)[0]
    one.write(batch)
    got = {(r.symbol, int(r.timestamp.timestamp() // 3600)): r.close for r in one.table().withColumn("timestamp", F.col("timestamp")).collect()}
    assert len(got) == 101 and sorted(got.values()).count(1.0) == 48 and {5.0, 8.0, 9.0} <= {*got.values()} and 6.0 not in got.values()
    assert not (tmp_path / f"buckets/{one.name}_1").exists()
    one.drop()


def test_inventory_from_footers(spark, tmp_path):
    from quantloom.operators.inventory import footer_inventory

    spark.range(100).withColumn("x", F.col("id") / 2).write.parquet(f"file://{tmp_path}/t")
    out = footer_inventory(spark, f"file://{tmp_path}/t", ("id", "x"))
    assert tuple(out.first()) == (100, 0, 99, 0.0, 49.5)
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(x), MAX(x)]" in out._jdf.queryExecution().executedPlan().toString()


EVENT = "kind string, time timestamp, seq long, order_id string, status string, reason string, fee double, slippage_bps double, latency_ms double, equity double, drawdown double"


def execution_rows():
    at = lambda k: datetime.fromtimestamp(1_700_000_000 + k, UTC)
    no = (None,) * 5
    rows = [("order", at(k), k, f"o{k}", s, None, *no) for k, s in enumerate(("FILLED", "FILLED", "DENIED", "unheard of"))] + [("order", at(9), 9, "", "FILLED", None, *no)]
    rows += [("denial", at(10 + k), 10 + k, None, None, r, *no) for k, r in enumerate(("spread", "secret", None))]
    rows += [("fill", at(20 + k), 20 + k, None, None, None, fee, slip, late, None, None) for k, (fee, slip, late) in enumerate(((1.0, -3.0, 0.02), (0.5, 2.5, 11.0), (-1.0, 0.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, float("inf")), (None, 1.0, 1.0)))]
    rows += [("portfolio", at(30 + k), 30 + k, None, None, None, None, None, None, e, d) for k, (e, d) in enumerate(((100.0, 0.1), (90.0, 0.2), (0.0, 0.2), (80.0, 1.5)))]
    return [*rows, ("other", at(50), 50, None, None, None, *no)]


def told(rows):
    return {(r[0], r[1], r[2]): r[3] for r in map(tuple, rows)}


def test_metrics(spark):
    events = spark.createDataFrame(execution_rows(), EVENT).repartition(4)
    got = told(monitor.metrics(events).collect())
    assert got["order_events_total", "FILLED", None] == 2 and got["order_events_total", "DENIED", None] == 1
    assert got["risk_denials_total", "spread", None] == 1 and got["risk_denials_total", "other", None] == 2
    assert got["fills_total", "", None] == 2 and got["fees_total", "", None] == 1.5 and got["rejected_total", "", None] == 9
    assert got["equity", "", None] == 90 and got["drawdown", "", None] == 0.2
    assert got["slippage_bps_bucket", "", 0.005] == 1 and got["slippage_bps_bucket", "", 2.5] == 2 and got["latency_ms_bucket", "", 10.0] == 1 and got["latency_ms_bucket", "", float("inf")] == 2
    empty = told(monitor.metrics(events.where("false")).collect())
    assert empty["fills_total", "", None] == 0 and ("equity", "", None) not in empty
    watched, seen = monitor.observed(events, "one pass")
    assert watched.count() == len(execution_rows())
    assert {k: v for k, v in got.items() if k[0] not in ("order_events_total", "risk_denials_total")} == told(monitor.as_rows(seen.get))


def test_metrics_of_a_stream_add_up(spark, tmp_path):
    events = spark.createDataFrame(execution_rows(), EVENT)
    for k in range(3):
        events.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    flow = monitor.observed_stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), "seen")
    run = flow.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    parts = [(*r, k) for k, p in enumerate(run.recentProgress) if "seen" in (p.observedMetrics or {}) for r in monitor.as_rows(p.observedMetrics["seen"].asDict() if hasattr(p.observedMetrics["seen"], "asDict") else p.observedMetrics["seen"])]
    assert len({p[-1] for p in parts}) >= 3
    merged = told(monitor.merged(spark.createDataFrame(parts, f"{monitor.SCHEMA}, part int")).collect())
    whole = {k: v for k, v in told(monitor.metrics(events).collect()).items() if k[0] not in ("order_events_total", "risk_denials_total", "equity", "drawdown")}
    assert {k: v for k, v in merged.items() if k[0] not in ("equity", "drawdown")} == whole


def test_orders_meet_their_last_portfolio(spark):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC)
    orders = spark.createDataFrame([(1, "a", at(100), "USD", 10.0), (2, "a", at(5), "USD", 10.0), (3, "none", at(100), "USD", 10.0), (4, "a", at(10), "USD", 10.0), (5, "a", None, "USD", 10.0), (6, "a", at(9_999_999), "USD", 10.0)], "id long, account string, submitted_at timestamp, quote_currency string, notional double")
    shots = spark.createDataFrame([("a", at(10), 1, "USD", 100.0, 0.0, 0.0, 0.0), ("a", at(10), 2, "USD", 200.0, 0.0, 0.0, 0.0), ("a", at(90), 3, "USD", 1.0, 100.0, 0.0, 0.0)], "account string, as_of timestamp, n long, base_currency string, equity double, gross double, daily_loss double, drawdown double")
    rows = risk.with_portfolio(orders, shots, "account", "submitted_at", "as_of", ties=["n"])
    found = {r.id: (r.n, r.snapshot_age_ms) for r in rows.collect()}
    assert found == {1: (3, 10_000.0), 2: (1, -5_000.0), 3: (None, None), 4: (2, 0.0), 5: (None, None), 6: (3, 9_999_909_000.0)}
    limits = (100.0, 10.0, 0.5, 2.0, 3_600_000.0)
    why = {r.id: r.reason for r in risk.authorized(rows, "paper", limits, "as_of").collect()}
    assert why == {1: "leverage limit exceeded", 2: "portfolio snapshot is from the future", 3: risk.NO_SNAPSHOT, 4: None, 5: risk.NO_SNAPSHOT, 6: "portfolio snapshot is stale"}
    assert {r.reason for r in risk.authorized(rows, "live", limits, "as_of").collect()} == {risk.DISABLED}


def test_p_values_outside_their_range_raise(spark):
    for p in (-0.1, 1.1, float("nan"), None):
        with pytest.raises(Exception, match="from 0 to 1"):
            stats.adjust_pvalues(spark.createDataFrame([("f", 0.5), ("f", p)], "family string, p double"), "bonferroni", ["family"]).collect()


def test_a_scan_needs_unique_times(spark):
    from quantloom.operators.simulate import scan_thresholds

    rows = panel(spark, [("a", 1, 1.0, 1), ("a", 2, 2.0, 1)]).withColumn("x", F.lit(0.5))
    assert scan_thresholds(rows, "x", [0.0]).count() == 1
    with pytest.raises(Exception, match="at one time"):
        scan_thresholds(rows.union(rows.limit(1)), "x", [0.0]).collect()


def feed_lines(n, connection="c1", first=0):
    level = lambda side, p, q: {"side": side, "price_level": str(p), "new_quantity": str(q)}
    out = []
    for k in range(first, first + n):
        ups = [level("bid", 100, 1), level("offer", 200, 1)] if k == 0 else [level("bid", 101 + k * 7 % 40, k % 5), level("offer", 160 + k * 11 % 30, (k + 1) % 4)]
        text = {"channel": "l2_data", "sequence_num": k, "timestamp": "2025-01-01T00:00:00Z", "events": [{"type": "snapshot" if k == 0 else "update", "product_id": "A", "updates": ups}]}
        out.append(json.dumps({"line": k + 1, "event": "message", "connection_id": connection, "raw_text": "{" if k % 13 == 5 else json.dumps(text)}))
    return out


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    from quantloom.sources.feed import read_log, stream_log
    from quantloom.streaming.book_stream import book_states

    folder = tmp_path / "log"
    folder.mkdir()

    found = []
    for k in range(3):  # each run starts from the checkpoint of the one before
        (folder / f"{k}.jsonl").write_text("\n".join(feed_lines(20, first=20 * k)) + "\n")
        flow = book_states(stream_log(spark, str(folder), 1)).writeStream.outputMode("update").foreachBatch(lambda batch, _: found.extend(batch.collect()))
        flow.option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(200)
    assert len(found) == 3
    last = found[-1]
    want = book.final_states(read_log(spark, str(folder)).withColumn("source", F.lit("one"))).first()
    assert (last.updates, last.errors, last.digest) == (want.updates, want.errors, want.digest) and want.errors > 0


def test_a_state_of_an_older_schema_is_read_on(spark, tmp_path):
    """A field added at the end of a state's schema is null for what was stored before."""
    from quantloom.sources.feed import read_log, stream_log
    from quantloom.streaming.book_stream import BOOK, BookProcessor, book_states, stateful

    class Older(BookProcessor):
        def init(self, handle):
            self.handle = handle
            self.connection = handle.getValueState("connection", "sequence long, beat long, errors long")
            self.books = handle.getMapState("books", "product string", BOOK)
            self.levels = handle.getMapState("levels", "product string, side string, price string", "size string")

        def counters(self, session, errors):
            return session.sequence, session.beat, errors

    folder, found = tmp_path / "log", []
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro")
    for k, make in enumerate((lambda log: stateful(log, Older()), book_states)):
        (folder / f"{k}.jsonl").write_text("\n".join(feed_lines(20, first=20 * k)) + "\n")
        flow = make(stream_log(spark, str(folder), 1)).writeStream.outputMode("update").foreachBatch(lambda batch, _: found.extend(batch.collect()))
        flow.option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(200)
    want = book.final_states(read_log(spark, str(folder)).withColumn("source", F.lit("one"))).first()
    assert len(found) == 2 and (found[-1].updates, found[-1].errors, found[-1].digest) == (want.updates, want.errors, want.digest)


def test_a_silent_connection_goes_stale(spark, tmp_path):
    import time

    from quantloom.sources.feed import stream_log
    from quantloom.streaming.book_stream import book_states

    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(feed_lines(5)) + "\n")
    flow = book_states(stream_log(spark, str(folder), 1), stale_ms=2_000).writeStream.outputMode("update").format("memory").queryName("stale").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for k in range(60):
            time.sleep(1)
            if k == 8:
                (folder / "b.jsonl").write_text("\n".join(feed_lines(1, "c2")) + "\n")
            found = spark.sql("select * from stale where connection_id = 'c1'").collect()
            if any(r.product is None for r in found):
                break
        assert [r.product for r in found] == ["A", None] and found[-1].digest is None
    finally:
        flow.stop()


def test_a_message_of_several_events_is_undone_whole():
    level = lambda side, p, q: {"side": side, "price_level": p, "new_quantity": q}
    text = lambda n, *events: json.dumps({"channel": "l2_data", "sequence_num": n, "timestamp": "2025-01-01T00:00:00Z", "events": [{"type": k, "product_id": p, "updates": u} for k, p, u in events]})
    both = [level("bid", "100", "1"), level("offer", "101", "1")]
    s = book.Session()
    s.apply(text(0, ("snapshot", "A", both)))
    before = s.books["A"].digest()
    for n, events in enumerate(([("update", "A", [level("bid", "99", "2"), level("bid", "100", "0")]), ("snapshot", "A", both), ("update", "A", [level("bid", "98", "3")]), ("update", "A", [level("bid", "150", "1")])], [("snapshot", "B", both), ("update", "C", both)]), 1):
        with pytest.raises(book.BookError):
            s.apply(text(n, *events))
        assert s.books["A"].digest() == before and set(s.books) == {"A"} and s.books["A"].updates == 0
        assert s.books["A"].sides["bid"].prices == sorted(s.books["A"].sides["bid"].sizes)
