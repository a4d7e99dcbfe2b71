"""Order gates as reason columns: the first failing rule of an ordered list, null where all pass.

Gates fail closed: a rule of unknown value denies the order, so do missing limits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scans import asof_join

# The reasons of a denial.
INCOMPLETE = "risk limits are incomplete"
NO_FRESHNESS = "risk configuration incomplete: snapshot freshness limit is missing"
DISABLED = "execution mode is not paper"
NO_SNAPSHOT = "no portfolio snapshot"
#: Orders and snapshots of an account are dealt out by spans of so many microseconds (a week).
GATE_SPAN = 604_800_000_000


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds or cannot be decided."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(F.coalesce(fails, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def limit_reason(max_notional: float | None, max_daily_loss: float | None, max_drawdown: float | None, max_leverage: float | None, max_snapshot_age_ms: float | None) -> Column:
    """Reason for rows (quote_currency, base_currency, notional, daily_loss, drawdown, gross, equity): over a size limit, at or
    over a loss limit. Every order adds to the exposure."""
    if None in (max_notional, max_daily_loss, max_drawdown, max_leverage, max_snapshot_age_ms):
        return F.lit(INCOMPLETE)
    return first_reason([
        ("order and portfolio currencies differ", F.col("quote_currency") != F.col("base_currency")),
        ("maximum order notional exceeded", F.col("notional") > max_notional),
        ("daily loss limit reached", F.col("daily_loss") >= max_daily_loss),
        ("drawdown limit reached", F.col("drawdown") >= max_drawdown),
        ("leverage limit exceeded", F.col("gross") + F.col("notional") > F.col("equity") * max_leverage),
    ])


def gate_reason(mode: str, max_notional: float | None, max_daily_loss: float | None, max_drawdown: float | None, max_leverage: float | None, max_snapshot_age_ms: float | None) -> Column:
    """limit_reason() behind the execution mode and the age of the portfolio snapshot (snapshot_age_ms)."""
    if mode != "paper":
        return F.lit(DISABLED)
    age = F.col("snapshot_age_ms")
    rules = [("portfolio snapshot is from the future", age < 0)]
    rules.append((NO_FRESHNESS, F.lit(True)) if max_snapshot_age_ms is None else ("portfolio snapshot is stale", age > max_snapshot_age_ms))
    return F.coalesce(first_reason(rules), limit_reason(max_notional, max_daily_loss, max_drawdown, max_leverage, max_snapshot_age_ms))


def with_portfolio(orders: DataFrame, snapshots: DataFrame, account: str, submitted: str, as_of: str, width: int = GATE_SPAN, ties: Sequence[str] = ()) -> DataFrame:
    """orders with the columns of the account's last snapshot at or before submission, and snapshot_age_ms.

    An order older than all snapshots of its account gets the first one, of negative age. Accounts without a snapshot and orders
    without a time have nulls. Of snapshots of one time that of the largest ties counts.
    """
    own = [c for c in snapshots.columns if c != account]
    found = asof_join(orders, snapshots, [account], submitted, as_of, width, ties, "_portfolio")
    last = F.coalesce("_portfolio", "_portfolio_first")
    rows = found.withColumn("_portfolio", last)
    age = (F.unix_micros(submitted) - F.unix_micros(F.col(f"_portfolio.{as_of}"))) / 1000
    return rows.select(*orders.columns, *(F.col(f"_portfolio.{c}").alias(c) for c in own), age.alias("snapshot_age_ms"))


def authorized(orders: DataFrame, mode: str, limits: tuple[float | None, ...], as_of: str) -> DataFrame:
    """orders (with_portfolio) with reason: why the gate denies an order, null where it passes."""
    gate = gate_reason(mode, *limits)
    return orders.withColumn("reason", gate if mode != "paper" else F.when(F.col(as_of).isNull(), F.lit(NO_SNAPSHOT)).otherwise(gate))


def quote_reason(max_age_ms: float, max_spread_bps: float, max_deviation_bps: float, max_position_fraction: float) -> Column:
    """Reason for rows (order_symbol, symbol, age_ms, bid, ask, reference_price, exposure, price, notional, equity): the market
    observation and the order's symbol position. Spread and deviation are relative to the reference price."""
    bps = lambda x: F.try_divide(x, F.col("reference_price")) * 10_000
    return first_reason([
        ("market symbol differs from order", F.col("symbol") != F.col("order_symbol")),
        ("market observation is stale or from the future", (F.col("age_ms") < 0) | (F.col("age_ms") > max_age_ms)),
        ("invalid current symbol exposure", F.col("exposure") < 0),
        ("market spread limit exceeded", bps(F.col("ask") - F.col("bid")) > max_spread_bps),
        ("order price deviates from reference", bps(F.abs(F.col("price") - F.col("reference_price"))) > max_deviation_bps),
        ("symbol position limit exceeded", F.col("exposure") + F.col("notional") > F.col("equity") * max_position_fraction),
    ])


def denial_kind(quote: Column, gate: Column) -> Column:
    """What a denial counts as: of the market check by its reason, of the gate behind it as portfolio; null if authorized."""
    kinds = (("stale", "stale_market"), ("spread", "spread"), ("deviates", "price_jump"), ("position", "position"))
    out = F.when(quote.isNull(), F.when(gate.isNotNull(), F.lit("portfolio")))
    for word, kind in kinds:
        out = out.when(quote.contains(word), F.lit(kind))
    return out.otherwise(F.lit("other"))


def denial_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("approved")).alias("outcome")).agg(F.count("*").alias("orders"))


def _blank(*names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | (F.col(name) == "")
    return out


# Row constraints of the domain records: true where a row breaks one.
VIOLATIONS = {
    "bar": lambda: _blank("symbol") | (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close", "low")),
    "signal": lambda: (F.col("observed_through") > F.col("as_of")) | F.isnan("score") | (F.abs("score") == float("inf")),
    "position": lambda: (F.col("weight") < -1) | (F.col("weight") > 1) | F.isnan("weight"),
    "order": lambda: _blank("client_order_id", "symbol", "quote_currency") | (F.col("quantity") <= 0) | (F.col("price") <= 0) | ~F.col("side").isin("buy", "sell"),
    "portfolio": lambda: _blank("base_currency") | (F.col("equity") <= 0) | (F.col("gross") < 0) | (F.col("daily_loss") < 0) | (F.col("drawdown") < 0) | (F.col("drawdown") > 1),
    "observation": lambda: _blank("symbol") | (F.least("bid", "ask", "reference_price") <= 0) | (F.col("bid") >= F.col("ask")),
}


def violations(rows: DataFrame, kind: str) -> DataFrame:
    """rows and violations; a row with an unknown value breaks its constraint."""
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(VIOLATIONS[kind](), F.lit(True))).alias("violations"))
