"""The panel engine: golden numbers, causality, books, gates, stores."""

import io
import json
import zipfile
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import book, factors, prepare, quality, risk, signals, simulate, stats, study
from quantloom.schemas import SCHEMAS, empty_frame, frame_from_rows, interval_ms

START = datetime(2025, 1, 1, tzinfo=UTC)
START_MS = int(START.timestamp() * 1000)


def sine_bars(spark, markets=1, n=80, change=None):
    """Four-hour bars on a sine; change: {bar number: factor of its close}."""
    rows = []
    for m in range(markets):
        for i in range(n):
            c = (100 + 50 * m + 0.02 * i + 3 * np.sin(i / 11)) * (change or {}).get(i, 1.0)
            o = c - 0.25 * np.sin(i / 3)
            rows.append(("x", f"m{m}", "4h", START + timedelta(hours=4 * i), float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), float((5 + np.sin(i / 7) + m) * (change or {}).get(i, 1.0)), START + timedelta(hours=4 * i + 5)))
    return spark.createDataFrame(rows, SCHEMAS["ohlcv"])


def test_schemas(spark):
    assert interval_ms("4h") == 14_400_000 and interval_ms("1w") == 604_800_000
    for bad in ("0h", "1M", "h", "4 h"):
        with pytest.raises(ValueError):
            interval_ms(bad)
    assert empty_frame(spark, "funding").count() == 0
    assert frame_from_rows(spark, "funding", [{"exchange": "x", "symbol": "a", "timestamp": START, "funding_rate": 0.1, "observed_at": START}]).count() == 1
    with pytest.raises(Exception):
        frame_from_rows(spark, "funding", [{"funding_rate": "text"}])


def test_clean_and_align(spark):
    bars = sine_bars(spark, 2, 12)
    assert prepare.clean_ohlcv(bars).count() == 24
    with pytest.raises(ValueError):
        prepare.clean_ohlcv(bars.withColumn("low", F.col("high") + 1))
    with pytest.raises(ValueError):
        prepare.clean_ohlcv(bars.union(bars))
    later = bars.withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).withColumn("volume", F.lit(9.0))
    assert prepare.clean_ohlcv(bars.union(later), "last_observed").agg(F.min("volume")).first()[0] == 9.0
    gap = bars.where("hour(timestamp) <> 8")
    end = START_MS + 12 * 14_400_000
    filled = prepare.align_ohlcv(gap, START_MS, end, "4h", "forward_close")
    assert filled.where("is_imputed").agg(F.count("*"), F.max("volume")).first()[:] == (4, 0.0)
    assert prepare.align_ohlcv(gap, START_MS, end, "4h").where("close is null").count() == 4
    assert quality.assess_ohlcv(gap, START_MS, end, "4h").first().missing_bars == 4
    assert not quality.assess_ohlcv(empty_frame(spark, "ohlcv"), START_MS, end, "4h").first().ok
    with pytest.raises(ValueError):
        prepare.require_complete_grid(gap)


def test_adjustments_know_no_future(spark):
    bars = sine_bars(spark, 1, 6)
    known = bars.select("exchange", "symbol", "timestamp", F.col("timestamp").alias("known_at"), F.lit(2.0).alias("price_factor"), F.lit(0.5).alias("volume_factor"))
    out = prepare.apply_adjustments(bars, known).join(bars.select("timestamp", F.col("close").alias("c")), "timestamp")
    assert out.where("abs(close - 2 * c) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        prepare.apply_adjustments(bars, known.withColumn("known_at", F.expr("timestamp + INTERVAL 1 MICROSECOND")))
    with pytest.raises(ValueError):
        prepare.apply_adjustments(bars, known.where("hour(timestamp) > 0"))


def test_factors_see_only_completed_bars(spark):
    specs = factors.standard_catalog((6,))
    names = [factors.factor_name(*s) for s in specs]
    read = lambda change: factors.compute_factors(sine_bars(spark, 2, 40, change), specs).orderBy("symbol", "timestamp").toPandas()
    plain, moved = read(None), read({20: 1.5})
    first = {"momentum_6": 7, "ma_gap_6": 6, "ema_gap_6": 6, "volume_return_correlation_6": 7, "bar_body": 1, "true_range": 2, "breakout_distance_6": 7}
    for name, k in first.items():
        own = plain[plain.symbol == "m0"][name].reset_index(drop=True)
        assert own.first_valid_index() == k, name
    for name in names:
        a, b = plain[name].to_numpy(float), moved[name].to_numpy(float)
        same = np.isclose(a, b, equal_nan=True)
        assert same[:21].all() and same[40:61].all(), name
        assert not same[21:40].all() or name == "close_location", name  # it does not change with scale
    ewm = plain[plain.symbol == "m0"].close.ewm(span=6, adjust=False, min_periods=6).mean()
    want = (plain[plain.symbol == "m0"].close / ewm - 1).shift(1)
    assert np.allclose(want, plain[plain.symbol == "m0"].ema_gap_6, equal_nan=True)


def test_corrections_golden(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.2)], "trial string, p double").withColumn("f", F.lit(1))
    for method, want in (("bonferroni", [0.03, 0.06, 0.6]), ("fdr_bh", [0.03, 0.03, 0.2])):
        got = [r.adjusted for r in stats.adjust_pvalues(p, method, ["f"]).orderBy("trial").collect()]
        assert got == pytest.approx(want)


def test_bootstrap_repeats(spark):
    rows = [("s", i, x) for i, x in enumerate((0.2, 0.4, 0.1, 0.3, 0.2, 0.5, 0.3, 0.1))]
    series = spark.createDataFrame(rows, "k string, i int, ic double")
    one, two = (stats.block_bootstrap(series, ["k"], "ic", "i", 2, 199, 7).first().p for _ in range(2))
    assert one == two and 0 < one < 0.05
    assert stats.block_bootstrap(series.limit(3), ["k"], "ic", "i", 2, 199, 7).first().p == 1.0


def test_folds():
    folds = [f for f in study.bar_folds(3828, 1080, 540, 1, 0.2) if f["fold"] >= 0]
    assert [(f["test_start"], f["test_end"]) for f in folds] == [(1081, 1621), (1621, 2161), (2161, 2701), (2701, 3061)]
    assert study.bar_folds(3828, 1080, 540, 1, 0.2)[-1]["test_start"] == 3062


def test_signal_delay_and_cash(spark):
    closes = (100.0, 100.0, 100.0, 100.0, 120.0, 120.0)
    rows = [("x", "a", "4h", START + timedelta(hours=4 * i), c, c, c, c, 1.0, START) for i, c in enumerate(closes)]
    frame = spark.createDataFrame(rows, SCHEMAS["ohlcv"])
    got = [r.t for r in frame.withColumn("t", signals.execution_target(2)).orderBy("timestamp").collect()]
    assert got == [False] * 5 + [True]
    with pytest.raises(ValueError):
        signals.execution_target(1)
    flat = spark.createDataFrame([("x", "a", "4h", START + timedelta(hours=4 * i), 100.0, 0) for i in range(3)], "exchange string, symbol string, timeframe string, timestamp timestamp, close double, pos int")
    out = simulate.excess_returns(flat).orderBy("timestamp").collect()
    assert out[0].excess > 0 and all(r.bar_return == 0 for r in out)


def test_strategies():
    for kind, params in (("momentum", {"window": 2, "threshold": 0.0}), ("ma_cross", {"fast": 12, "slow": 6}), ("momentum", {"window": 6}), ("nothing", {}), ("momentum_volume", {"window": 6, "volume_window": 2, "min_volume_ratio": 1.0}), ("momentum", {"window": 6, "threshold": float("nan")})):
        with pytest.raises(ValueError):
            signals.Strategy(kind, params)
    assert signals.needed_factors([signals.Strategy("ma_cross", {"fast": 6, "slow": 24}), signals.Strategy("body_followthrough", {"minimum": 0.0})]) == [("ma_gap", 6), ("ma_gap", 24), ("bar_body", None)]


def test_threshold_scan_guards(spark):
    frame = factors.compute_factors(sine_bars(spark, 1, 60), [("momentum", 6)])
    assert simulate.scan_thresholds(frame, "momentum_6", [0.0, 0.01]).count() == 2
    with pytest.raises(ValueError):
        simulate.scan_thresholds(frame, "momentum_6", [0.0], fee=None)


def feed(tmp_path):
    """A log of two connections with a gap in the first, a bad line and a rejected update."""
    level = lambda side, p, q: {"side": side, "price_level": p, "new_quantity": q}
    text = lambda n, kind, ups, second: json.dumps({"channel": "l2_data", "sequence_num": n, "timestamp": f"2025-01-01T00:00:{second:02}.000000000Z", "events": [{"type": kind, "product_id": "A", "updates": ups}]})
    both = [level("bid", "100", "1"), level("bid", "99.50", "2"), level("offer", "101", "1")]
    messages = [
        ("c1", "connection_start", None), ("c1", "message", text(0, "snapshot", both, 0)), ("c1", "message", text(1, "update", [level("bid", "100.5", "3"), level("bid", "100", "0")], 1)),
        ("c1", "message", text(2, "update", [level("bid", "102", "1")], 2)), ("c1", "message", "not json"), ("c1", "message", text(4, "update", [level("bid", "98", "1")], 4)), ("c1", "message", text(5, "update", [level("bid", "97", "1")], 5)),
        ("c2", "connection_start", None), ("c2", "message", text(7, "snapshot", both, 6)), ("c2", "message", text(8, "update", [level("offer", "101", "5")], 7)),
    ]
    lines = [json.dumps({"line": k, "event": e, "connection_id": c, "raw_text": t}) for k, (c, e, t) in enumerate(messages)]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(lines[:6]) + "\n")
    (folder / "b.jsonl").write_text("\n".join(lines[6:]) + "\nbroken line\n")
    return str(folder)


def test_book_batch_equals_stream(spark, tmp_path):
    from quantloom.sources.feed import read_log, stream_log
    from quantloom.streaming.book_stream import book_states

    folder = feed(tmp_path)
    log = read_log(spark, folder).withColumn("source", F.lit("one"))
    assert log.where("event = 'malformed'").count() == 1
    two = book.final_states(log.union(log.withColumn("source", F.lit("two")))).collect()
    assert sorted((r.source, r.epoch) for r in two) == [(s, k) for s in ("one", "two") for k in (1, 2)]
    states = {r.epoch: r for r in book.final_states(log).collect()}
    assert states[1].updates == 1 and states[1].errors == 4 and states[2].updates == 1 and states[2].errors == 0
    top = {(r.side, r.level): str(r.price) for r in book.replay(log, depth=2).where("epoch = 1 and updates = 1").collect()}
    assert float(top["bid", 1]) == 100.5 and float(top["bid", 2]) == 99.5 and float(top["ask", 1]) == 101
    flow = book_states(stream_log(spark, folder, 2)).writeStream.outputMode("update").format("memory").queryName("books").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    flow.awaitTermination(120)
    got = {r.connection_id: r for r in spark.sql("select * from books").collect()}
    assert got["c1"].digest == states[1].digest and got["c2"].digest == states[2].digest and got["c1"].errors == 4


def test_book_rules():
    b, at = book.Book(), book.event_time("2025-01-01T00:00:01Z")
    with pytest.raises(book.BookError):
        b.update([], at)
    b.snapshot([("bid", "1", "1"), ("ask", "2", "1")], at)
    for wrong in ([("bid", "2", "1")], [("bid", "1", "0")], [("bid", "nan", "1")], [("bid", "-1", "1")]):
        with pytest.raises(book.BookError):
            b.update(wrong, at)
    assert b.updates == 0 and book.canonical(book.decimal("100.00")) == "100"
    with pytest.raises(book.BookError):
        b.update([("bid", "1", "2")], book.event_time("2025-01-01T00:00:00.999999999Z"))


def test_malformed_messages_are_rejected():
    level = lambda side, p, q: {"side": side, "price_level": p, "new_quantity": q}
    both = [level("bid", "100", "1"), level("offer", "101", "1")]
    event = lambda kind, ups, product="A": {"type": kind, "product_id": product, "updates": ups}
    text = lambda n, *events, **more: json.dumps({"channel": "l2_data", "sequence_num": n, "timestamp": "2025-01-01T00:00:00Z", "events": list(events), **more})
    s = book.Session(["A", "B"])
    assert s.apply(text(0, event("snapshot", both), event("snapshot", both, "B"), event("snapshot", both, "C"))) == [("A", "snapshot"), ("B", "snapshot")]
    digest, n = s.books["A"].digest(), 0
    for wrong in (event("update", []), event("other", both), event("update", [{"side": "bid", "price_level": "1"}]), event("update", [level("left", "1", "1")]), event("update", [5]), event("snapshot", 5), 7, event("update", [level("bid", "102", "1")])):
        n += 1
        with pytest.raises(book.BookError):
            s.apply(text(n, event("update", [level("bid", "99", "1")]), wrong))
        assert s.books["A"].digest() == digest, wrong  # the first event of the message did not stay
    for wrong in (None, "5", "null", "[]", "{", text(True, event("update", both)), text(n + 5, event("update", both)), json.dumps({"channel": "l2_data", "events": []}), 5):
        with pytest.raises(book.BookError):
            s.apply(wrong)
    for more in ({"events": []}, {"events": 5}, {"timestamp": "soon"}, {"timestamp": None}, {"timestamp": "2025-01-01T00:00:00+01:00"}):
        n += 1
        with pytest.raises(book.BookError):
            s.apply(text(n, event("update", [level("bid", "99", "1")]), **more))
    assert s.apply(json.dumps({"channel": "status"})) == [] and s.apply(json.dumps({"channel": "status", "sequence_num": n + 1})) == []
    beat = lambda k, c: json.dumps({"channel": "heartbeats", "sequence_num": k, "events": [{"heartbeat_counter": c}]})
    assert s.apply(beat(n + 2, 4)) == [("", "heartbeat")]
    for k, c in ((n + 3, 6), (n + 4, True), (n + 5, None)):
        with pytest.raises(book.BookError):
            s.apply(beat(k, c))
    again = book.Session.read(s.written())
    assert again.books["B"].digest() == digest and again.sequence == s.sequence and again.beat == s.beat
    plain = book.Session()
    for wrong in ({"type": "snapshot", "product_id": "A", "asks": [["2", "1"]]}, {"type": "snapshot", "product_id": "A", "bids": [["1"]], "asks": [["2", "1"]]}, {"type": "l2update", "product_id": "A", "changes": [["buy", "1", "1"]]}, {"type": "heartbeat", "product_id": "A", "sequence": "1"}):
        with pytest.raises(book.BookError):
            plain.apply(json.dumps(wrong))
    assert plain.apply(json.dumps({"type": "snapshot", "product_id": "A", "bids": [["1", "1"]], "asks": [["2", "1"]]})) == [("A", "snapshot")]
    for wrong in ({"changes": [["left", "1", "1"]], "time": "2025-01-01T00:00:00Z"}, {"changes": [], "time": "2025-01-01T00:00:00Z"}, {"changes": [["buy", "1", "2"]]}):
        with pytest.raises(book.BookError):
            plain.apply(json.dumps({"type": "l2update", "product_id": "A", **wrong}))
    assert plain.apply(json.dumps({"type": "l2update", "product_id": "A", "changes": [["buy", "1", "2"]], "time": "2025-01-01T00:00:00Z"})) == [("A", "update")]
    assert plain.apply(json.dumps({"type": "heartbeat", "product_id": "A", "sequence": 3})) == [("A", "heartbeat")]


def test_risk_reasons(spark):
    limits = {"max_notional": 100, "max_daily_loss": 10, "max_drawdown": 0.5, "max_leverage": 2, "max_snapshot_age_ms": 1000}
    good = {"quote_currency": "USD", "base_currency": "USD", "notional": 50.0, "daily_loss": 0.0, "drawdown": 0.0, "gross": 0.0, "equity": 100.0, "snapshot_age_ms": 1000.0}
    cases = [
        ({}, None), ({"quote_currency": "EUR", "notional": 500.0}, "order and portfolio currencies differ"), ({"notional": 100.0}, None), ({"notional": 100.1, "daily_loss": 10.0}, "maximum order notional exceeded"),
        ({"daily_loss": 10.0, "drawdown": 0.5}, "daily loss limit reached"), ({"drawdown": 0.5, "gross": 1000.0}, "drawdown limit reached"), ({"gross": 150.0}, None), ({"gross": 150.1}, "leverage limit exceeded"),
        ({"equity": None}, "leverage limit exceeded"), ({"notional": None}, "maximum order notional exceeded"), ({"quote_currency": None}, "order and portfolio currencies differ"), ({"drawdown": None}, "drawdown limit reached"),
        ({"snapshot_age_ms": -1.0, "notional": 500.0}, "portfolio snapshot is from the future"), ({"snapshot_age_ms": 1000.1}, "portfolio snapshot is stale"),
    ]
    rows = spark.createDataFrame([(k, *{**good, **x}.values()) for k, (x, _) in enumerate(cases)], "i int, quote_currency string, base_currency string, notional double, daily_loss double, drawdown double, gross double, equity double, snapshot_age_ms double")
    read = lambda column: [r.r for r in rows.select("i", column.alias("r")).orderBy("i").collect()]
    assert read(risk.gate_reason("paper", **limits)) == [r for _, r in cases]
    assert set(read(risk.gate_reason("live", **limits))) == {risk.DISABLED}
    for name in limits:
        assert set(read(risk.limit_reason(**{**limits, name: None}))) == {risk.INCOMPLETE}
    assert read(risk.gate_reason("paper", **{**limits, "max_snapshot_age_ms": None}))[0] == risk.NO_FRESHNESS


def test_quote_reasons(spark):
    good = {"order_symbol": "A", "symbol": "A", "age_ms": 0.0, "bid": 99.0, "ask": 101.0, "reference_price": 100.0, "exposure": 0.0, "price": 100.0, "notional": 10.0, "equity": 100.0}
    cases = [
        ({}, None, None), ({"symbol": "B", "age_ms": -1.0}, "market symbol differs from order", "other"), ({"age_ms": -1.0}, "market observation is stale or from the future", "stale_market"), ({"age_ms": 11.0}, "market observation is stale or from the future", "stale_market"),
        ({"exposure": -0.1}, "invalid current symbol exposure", "other"), ({"ask": 101.1}, "market spread limit exceeded", "spread"), ({"price": 101.1}, "order price deviates from reference", "price_jump"), ({"reference_price": 102.0, "ask": 102.0}, "market spread limit exceeded", "spread"),
        ({"exposure": 40.1}, "symbol position limit exceeded", "position"), ({"price": None}, "order price deviates from reference", "price_jump"), ({"reference_price": 0.0}, "market spread limit exceeded", "spread"),
    ]
    rows = spark.createDataFrame([(k, *{**good, **x}.values()) for k, (x, *_) in enumerate(cases)], "i int, order_symbol string, symbol string, age_ms double, bid double, ask double, reference_price double, exposure double, price double, notional double, equity double")
    reason = risk.quote_reason(10, 200.0, 100.0, 0.5)
    got = rows.select("i", reason.alias("r"), risk.denial_kind(reason, F.lit(None).cast("string")).alias("k"), risk.denial_kind(F.lit(None).cast("string"), F.lit("x")).alias("g")).orderBy("i").collect()
    assert [(r.r, r.k) for r in got] == [x[1:] for x in cases] and {r.g for r in got} == {"portfolio"}


def test_grids_take_the_interval_begun(spark):
    hour = 3_600_000
    rows = [("x", "a", "2h", START + timedelta(hours=2 * k), 1.0, 1.0, 1.0, 1.0, 1.0, START) for k in range(2)]
    frame = spark.createDataFrame(rows, SCHEMAS["ohlcv"])
    assert prepare.align_ohlcv(frame, START_MS, START_MS + 5 * hour, "2h").count() == 3
    assert prepare.align_ohlcv(frame, START_MS, START_MS + 4 * hour, "2h").count() == 2
    eligible = spark.createDataFrame([("a", START, START + timedelta(days=1))], "symbol string, eligible_from timestamp, eligible_until timestamp")
    assert [r.status for r in prepare.calendar(frame, eligible, START_MS, START_MS + 5 * hour, "2h").orderBy("timestamp").collect()] == ["observed", "observed", "missing"]
    for start, end, wrong in ((START_MS, START_MS, frame), (START_MS + 1, START_MS + 5 * hour, frame), (START_MS, START_MS + 2 * hour, frame), (START_MS, START_MS + 5 * hour, frame.union(frame)), (START_MS, START_MS + 5 * hour, frame.withColumn("low", F.lit(2.0))), (START_MS, START_MS + 5 * hour, frame.withColumn("volume", F.lit(None).cast("double")))):
        with pytest.raises(ValueError):
            prepare.align_ohlcv(wrong, start, end, "2h")
    assert prepare.clean_ohlcv(frame.union(frame), "last_observed").count() == 2


def test_selection(spark):
    rows = spark.createDataFrame([("a", 0.2, 0.04), ("b", 0.3, 0.06), ("c", -0.5, 0.01), ("d", 0.2, 0.05)], "strategy string, mean_excess double, adjusted double")
    assert [r.strategy for r in study.select_strategy(rows, 0.05).where("selected").collect()] == ["a"]
    assert study.select_strategy(rows, 0.001).where("selected").count() == 0
    assert [(r.strategy, r.place) for r in study.notable(rows, F.abs("mean_excess"), "strategy", 3).orderBy("place").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    with pytest.raises(ValueError):
        study.bar_folds(110, 60, 60, 1, 0.2)
    with pytest.raises(ValueError):
        stats.ic_series(rows, "x", 0)


def test_store_and_archive(spark, tmp_path):
    from quantloom.sources.archive import epoch_ms, months_between, read_archives, read_months
    from quantloom.sources.store import PanelStore, file_digests, write_once

    store = PanelStore(spark, f"file://{tmp_path}/store")
    assert store.read("ohlcv").count() == 0
    bars = sine_bars(spark, 2, 6)
    store.write("ohlcv", bars)
    store.write("ohlcv", bars.withColumn("volume", F.lit(7.0)).withColumn("observed_at", F.expr("observed_at + INTERVAL 1 DAY")).where("symbol = 'm0'"))
    assert store.read("ohlcv").count() == 12 and store.read("ohlcv", symbol="m0").agg(F.min("volume")).first()[0] == 7.0
    assert store.read("ohlcv", START_MS, START_MS + 14_400_000 * 2, symbol="m1").count() == 2
    assert sorted(p.parts[-3] for p in (tmp_path / "store/ohlcv/markets").rglob("_v=*")) == ["symbol=m0", "symbol=m0", "symbol=m1"]  # the other market stayed
    assert store.vacuum("ohlcv") == 1 and len(list((tmp_path / "store/ohlcv/markets").rglob("_v=*"))) == 2
    assert store.read("ohlcv").count() == 12 and store.vacuum("ohlcv") == 0 and store.vacuum("funding") == 0
    write_once(bars, f"file://{tmp_path}/once", {"a": 1})
    write_once(bars, f"file://{tmp_path}/once", {"a": 1})
    with pytest.raises(ValueError):
        write_once(bars.limit(3), f"file://{tmp_path}/once", {"a": 1})
    assert file_digests(spark, f"file://{tmp_path}/once/*.parquet").count() >= 1
    (tmp_path / "zips").mkdir()
    text = "".join(f"{(START_MS + k * 14_400_000) * 1000},1,2,0.5,1.5,10,0,0,0,0,0,0\n" for k in range(3))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", text)
    (tmp_path / "zips/a.zip").write_bytes(buffer.getvalue())
    got = read_archives(spark, f"file://{tmp_path}/zips", "A", "4h", START_MS, START_MS + 3 * 14_400_000)
    assert got.count() == 3 and got.agg(F.max("close")).first()[0] == 1.5
    for digests, end in (({"a.zip": "0"}, 3), (None, 2)):
        with pytest.raises(Exception):
            read_archives(spark, f"file://{tmp_path}/zips", "A", "4h", START_MS, START_MS + end * 14_400_000, digests).collect()
    with pytest.raises(ValueError):
        epoch_ms(5)
    month = int(datetime(2025, 2, 1, tzinfo=UTC).timestamp() * 1000)
    got = read_months(spark, f"file://{tmp_path}/zips", "A", "4h", START_MS, month)
    assert [r.timestamp for r in got.select("timestamp").collect()] == sorted(r.timestamp for r in got.select("timestamp").collect()) and got.count() == 3
    for a, b in ((START_MS, int(datetime(2025, 3, 1, tzinfo=UTC).timestamp() * 1000)), (START_MS, month - 1), (month, START_MS)):
        with pytest.raises(ValueError):
            read_months(spark, f"file://{tmp_path}/zips", "A", "4h", a, b)
    assert months_between(int(datetime(2024, 11, 1, tzinfo=UTC).timestamp() * 1000), month) == ["2024-11", "2024-12", "2025-01"]


def test_one_shuffle_by_market(spark):
    plan = factors.compute_factors(sine_bars(spark, 1, 30), [("momentum", 6), ("bollinger_z", 12), ("true_range", None)], checked=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
