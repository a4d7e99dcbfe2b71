"""Queries of the order gate over time, of the execution monitor and of the domain's record rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import monitor, prepare, risk
from quantloom.plans.panel_queries import bars_sql, observations, sound_bars, sound_bars_sql, t_ms
from quantloom.plans.registry import query
from quantloom.sources.bars import event_bars

DAY_MS = 86_400_000
#: Limits of the gate: notional, daily loss, drawdown, leverage, and the age of a snapshot in milliseconds (thirty days).
LIMITS = (300_000, 900, 0.8, 8, 30 * DAY_MS)

# Orders of forty accounts, the first of which has a third of all. Every fifth order is a snapshot of its account, too: the
# last accounts have none, others only late ones, and snapshots of one account and time are told apart by their order.
ASOF_SQL = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END AS account, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate + INTERVAL (o_orderkey % 24) HOUR END AS submitted_at,
  CASE WHEN o_orderkey % 11 = 0 THEN 'EUR' ELSE 'USD' END AS quote_currency, o_totalprice AS notional FROM orders),
s AS (SELECT o_custkey % 40 AS account, o_orderdate + INTERVAL (o_orderkey % 3 * 6) HOUR AS as_of, o_orderkey AS snapshot, o_totalprice / 4 AS equity, o_totalprice AS gross, (o_orderkey % 97) * 10.0::DOUBLE AS daily_loss, (o_orderkey % 89) / 100.0::DOUBLE AS drawdown FROM orders
  WHERE o_orderkey % 5 = 1 AND o_custkey % 40 < 36 AND (o_custkey % 40 < 30 OR o_orderdate >= TIMESTAMP '1998-06-01')),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY account, as_of ORDER BY snapshot DESC) = 1),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY account ORDER BY as_of, snapshot) = 1),
l AS (SELECT o.*, d.as_of, d.snapshot, d.equity, d.gross, d.daily_loss, d.drawdown FROM o ASOF LEFT JOIN d ON o.account = d.account AND o.submitted_at >= d.as_of),
j AS (SELECT l.o_orderkey, l.account, l.submitted_at, l.quote_currency, l.notional, coalesce(l.as_of, h.as_of) AS as_of, coalesce(l.snapshot, h.snapshot) AS snapshot, coalesce(l.equity, h.equity) AS equity, coalesce(l.gross, h.gross) AS gross,
  coalesce(l.daily_loss, h.daily_loss) AS daily_loss, coalesce(l.drawdown, h.drawdown) AS drawdown FROM l LEFT JOIN h ON h.account = l.account AND l.submitted_at IS NOT NULL)"""


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    hours = F.make_interval(hours=(key % 24).cast("int"))
    account = F.when(key % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey") % 40).cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", account.alias("account"), F.when(key % 101 != 0, at + hours).alias("submitted_at"), F.when(key % 11 == 0, "EUR").otherwise("USD").alias("quote_currency"), F.col("o_totalprice").alias("notional"))


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    account = (F.col("o_custkey") % 40).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where((key % 5 == 1) & (account < 36) & ((account < 30) | (at >= F.to_timestamp(F.lit("1998-06-01")))))
    return rows.select(account.alias("account"), (at + F.make_interval(hours=(key % 3 * 6).cast("int"))).alias("as_of"), key.alias("snapshot"), F.lit("USD").alias("base_currency"), (F.col("o_totalprice") / 4).alias("equity"), F.col("o_totalprice").alias("gross"), (key % 97 * 10.0).alias("daily_loss"), (key % 89 / 100.0).alias("drawdown"))


@query(f"""WITH {ASOF_SQL} SELECT o_orderkey, account, snapshot, CAST(epoch_ms(submitted_at) - epoch_ms(as_of) AS DOUBLE) AS snapshot_age_ms FROM j""")
def latest_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the last snapshot of its account, and that snapshot's age."""
    rows = risk.with_portfolio(dated_orders(spark, sf_dir), portfolios(spark, sf_dir), "account", "submitted_at", "as_of", ties=["snapshot"])
    return rows.select("o_orderkey", "account", "snapshot", "snapshot_age_ms")


@query(f"""WITH {ASOF_SQL}, a AS (SELECT *, epoch_ms(submitted_at) - epoch_ms(as_of) AS age FROM j)
SELECT o_orderkey, CASE WHEN as_of IS NULL THEN 'no portfolio snapshot' WHEN age < 0 THEN 'portfolio snapshot is from the future' WHEN age > {LIMITS[4]} THEN 'portfolio snapshot is stale'
  WHEN quote_currency <> 'USD' THEN 'order and portfolio currencies differ' WHEN notional > {LIMITS[0]} THEN 'maximum order notional exceeded' WHEN daily_loss >= {LIMITS[1]} THEN 'daily loss limit reached'
  WHEN drawdown >= {LIMITS[2]} THEN 'drawdown limit reached' WHEN gross + notional > equity * {LIMITS[3]} THEN 'leverage limit exceeded' END AS reason FROM a""")
def paper_order_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the gate denies an order against the last snapshot of its account; null where it passes."""
    rows = risk.with_portfolio(dated_orders(spark, sf_dir), portfolios(spark, sf_dir), "account", "submitted_at", "as_of", ties=["snapshot"])
    return risk.authorized(rows, "paper", LIMITS, "as_of").select("o_orderkey", "reason")


# Execution events: every event is an order's state, a denial, a fill or a portfolio value; some break the rules.
MONITOR_SQL = f"""e AS (SELECT *, event_id % 4 AS k FROM events),
f AS (SELECT ts, event_id, k, CASE WHEN event_id % 37 = 0 THEN 'LOST' WHEN event_type = 'purchase' THEN 'FILLED' WHEN event_type = 'click' THEN 'ACCEPTED' ELSE 'SUBMITTED' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'spread' WHEN event_id % 3 = 1 THEN 'position' ELSE event_type END AS reason,
  CASE WHEN event_id % 29 <> 1 THEN (event_id % 50) / 8.0::DOUBLE END AS fee, (event_id % 81 - 30) / 4.0::DOUBLE AS slippage, CASE WHEN event_id % 31 = 1 THEN -1 ELSE (event_id % 97) / 8.0::DOUBLE END AS latency, value AS equity, (event_id % 120) / 100.0::DOUBLE AS drawdown FROM e),
v AS (SELECT *, coalesce(CASE k WHEN 0 THEN status <> 'LOST' WHEN 1 THEN fee >= 0 AND latency >= 0 WHEN 2 THEN true ELSE equity > 0 AND drawdown BETWEEN 0 AND 1 END, false) AS valid FROM f),
b AS (SELECT unnest([{', '.join(f"{b}::DOUBLE" if b < 1e9 else "'inf'::DOUBLE" for b in monitor.BOUNDS)}]) AS le)"""


def execution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, time, seq, order_id, status, reason, fee, slippage_bps, latency_ms, equity, drawdown."""
    k, kind = F.col("event_id"), F.col("event_type")
    status = F.when(k % 37 == 0, "LOST").when(kind == "purchase", "FILLED").when(kind == "click", "ACCEPTED").otherwise("SUBMITTED")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.element_at(F.array(*map(F.lit, ("order", "fill", "denial", "portfolio"))), (k % 4 + 1).cast("int")).alias("kind"), F.col("ts").cast("timestamp").alias("time"), k.alias("seq"), k.cast("string").alias("order_id"), status.alias("status"),
        F.when(k % 3 == 0, "spread").when(k % 3 == 1, "position").otherwise(kind).alias("reason"), F.when(k % 29 != 1, k % 50 / 8.0).alias("fee"), ((k % 81 - 30) / 4.0).alias("slippage_bps"),
        F.when(k % 31 == 1, -1.0).otherwise(k % 97 / 8.0).alias("latency_ms"), F.col("value").alias("equity"), (k % 120 / 100.0).alias("drawdown"),
    )


@query(f"""WITH {MONITOR_SQL}
SELECT 'order_events_total' AS metric, status AS label, CAST(NULL AS DOUBLE) AS le, CAST(count(*) AS DOUBLE) AS value FROM v WHERE k = 0 AND valid GROUP BY status
UNION ALL SELECT 'risk_denials_total', CASE WHEN reason IN ('stale_market', 'spread', 'price_jump', 'position', 'portfolio') THEN reason ELSE 'other' END, NULL, CAST(count(*) AS DOUBLE) FROM v WHERE k = 2 GROUP BY 2
UNION ALL SELECT 'fills_total', '', NULL, CAST(count(*) AS DOUBLE) FROM v WHERE k = 1 AND valid
UNION ALL SELECT 'fees_total', '', NULL, coalesce(sum(fee), 0) FROM v WHERE k = 1 AND valid
UNION ALL SELECT 'rejected_total', '', NULL, CAST(count(*) AS DOUBLE) FROM v WHERE NOT valid
UNION ALL SELECT 'slippage_bps_sum', '', NULL, coalesce(sum(slippage), 0) FROM v WHERE k = 1 AND valid
UNION ALL SELECT 'latency_ms_sum', '', NULL, coalesce(sum(latency), 0) FROM v WHERE k = 1 AND valid
UNION ALL SELECT * FROM (SELECT 'equity', '', NULL, equity FROM v WHERE k = 3 AND valid ORDER BY ts DESC, event_id DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'drawdown', '', NULL, drawdown FROM v WHERE k = 3 AND valid ORDER BY ts DESC, event_id DESC LIMIT 1)
UNION ALL SELECT 'slippage_bps_bucket', '', le, CAST(count(v.k) AS DOUBLE) FROM b LEFT JOIN v ON v.k = 1 AND v.valid AND v.slippage <= b.le GROUP BY le
UNION ALL SELECT 'latency_ms_bucket', '', le, CAST(count(v.k) AS DOUBLE) FROM b LEFT JOIN v ON v.k = 1 AND v.valid AND v.latency <= b.le GROUP BY le""")
def execution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.metrics(execution_events(spark, sf_dir))


def _rules(kind: str, rows: DataFrame) -> DataFrame:
    return risk.violations(rows, kind)


@query(f"""WITH {bars_sql('1h')}, b AS (SELECT *, (t // 3600000) % 7 AS k FROM bars),
c AS (SELECT open, high, CASE WHEN k = 0 THEN high + 1 WHEN k <> 3 THEN low END AS low, close, CASE WHEN k = 1 THEN -volume ELSE volume END AS volume FROM b)
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) FILTER (WHERE low IS NULL OR least(open, high, low, close) <= 0 OR volume < 0 OR low > least(open, close) OR high < greatest(open, close, low)) AS BIGINT) AS violations FROM c""")
def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("unix_millis(timestamp) div 3600000 % 7")
    low = F.when(k == 0, F.col("high") + 1).when(k != 3, F.col("low"))
    return _rules("bar", event_bars(spark, sf_dir, "1h").withColumns({"low": low, "volume": F.when(k == 1, -F.col("volume")).otherwise(F.col("volume"))}))


@query("""SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) FILTER (WHERE event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0) AS BIGINT) AS violations FROM events""")
def signal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of events: some look a second ahead, some are not numbers, some are unknown."""
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    score = F.when(k % 17 == 0, float("nan")).when(k % 19 != 0, F.col("value"))
    return _rules("signal", spark.read.parquet(f"{sf_dir}/events.parquet").select(at.alias("as_of"), F.when(k % 13 == 0, at + F.expr("INTERVAL 1 SECOND")).otherwise(at).alias("observed_through"), score.alias("score")))


@query("""WITH w AS (SELECT CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey % 251 - 120) / 110.0::DOUBLE END AS weight FROM orders) SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) FILTER (WHERE weight IS NULL OR abs(weight) > 1) AS BIGINT) AS violations FROM w""")
def position_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _rules("position", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(key % 23 != 0, (key % 251 - 120) / 110.0).alias("weight")))


@query("""SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) FILTER (WHERE l_orderkey % 7 = 0 OR l_linenumber % 5 = 0 OR l_orderkey % 11 = 0 OR l_partkey % 13 = 0) AS BIGINT) AS violations FROM lineitem""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as orders: some have no name, no quantity, an unknown price or a side that is none."""
    k = F.col("l_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("client_order_id"), F.lit("A").alias("symbol"), F.lit("USD").alias("quote_currency"), F.when(F.col("l_partkey") % 13 == 0, "hold").otherwise("buy").alias("side"),
        F.when(F.col("l_linenumber") % 5 == 0, 0.0).otherwise(F.col("l_quantity").cast("double")).alias("quantity"), F.when(k % 11 != 0, F.col("l_extendedprice").cast("double")).alias("price"),
    )
    return _rules("order", rows)


@query(f"WITH {sound_bars_sql('1h')} SELECT symbol, t AS t_ms, open, high, low, close, volume FROM bars")
def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_ohlcv by the policy that refuses duplicates."""
    return prepare.clean_ohlcv(sound_bars(spark, sf_dir, "1h")).select("symbol", t_ms(), "open", "high", "low", "close", "volume")


@query("""WITH r AS (SELECT event_type AS symbol, epoch_ms(ts) - epoch_ms(ts) % 3600000 AS t_ms, value, row_number() OVER (PARTITION BY event_type, epoch_ms(ts) // 3600000 ORDER BY ts DESC) AS k FROM events WHERE value > 0)
SELECT symbol, t_ms, value AS open, value AS close, 1.0::DOUBLE AS volume FROM r WHERE k = 1""")
def clean_bars_last_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_ohlcv by the policy that keeps the last observation of a key."""
    rows = observations(spark, sf_dir).where("value > 0").drop("event_id", "value")
    return prepare.clean_ohlcv(rows, "last_observed").select("symbol", t_ms(), "open", "close", "volume")
