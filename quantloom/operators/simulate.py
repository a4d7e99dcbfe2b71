"""Long/cash simulation on closes by running sums: positions, trades, equity, drawdown, Sharpe, threshold scans."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.schemas import GROUPS

CASH, NOTIONAL, FEE, SLIPPAGE, BARS_A_YEAR = 10_000.0, 100.0, 0.001, 0.001, 6 * 365


def ordered(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("timestamp")


def positions(frame: DataFrame, keys: tuple[str, ...] = GROUPS) -> DataFrame:
    """frame (entry, exit) with pos: 1 from an entry until an exit; both at once count for nothing.

    Each slice starts flat; its last bar takes no entry and exits. A slice is what the keys name.
    """
    w = ordered(keys)
    last = F.lead("timestamp").over(w).isNull()
    go, stop = F.col("entry") & ~F.col("_last"), F.col("exit") | F.col("_last")
    event = F.when(go & ~stop, 1).when(stop & ~go, 0)
    marked = frame.withColumn("_last", last).withColumn("_event", event)
    return marked.withColumn("pos", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_event", "_last")


def edges(frame: DataFrame, keys: tuple[str, ...] = GROUPS) -> DataFrame:
    """frame (target boolean) with entry and exit at its rising and falling edges; before the first row it is false."""
    before = F.coalesce(F.lag("target").over(ordered(keys)), F.lit(False))
    return frame.withColumns({"entry": F.col("target") & ~before, "exit": ~F.col("target") & before})


def equity(frame: DataFrame, keys: tuple[str, ...] = GROUPS, cash: float = CASH, notional: float = NOTIONAL, fee: float = FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """frame (close, pos) with buy, sell, equity and bar_return: a fixed notional for each trade, filled at the close.

    A buy pays close * (1 + slippage) and the fee, a sale gets close * (1 - slippage) less the fee. The first return is
    measured from the starting cash.
    """
    w = ordered(keys)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag("pos").over(w), F.lit(0))
    rows = frame.withColumns({"buy": (F.col("pos") == 1) & (before == 0), "sell": (F.col("pos") == 0) & (before == 1)})
    rows = rows.withColumn("_units", F.last(F.when(F.col("buy"), notional / F.col("close")), ignorenulls=True).over(past))
    flow = F.when(F.col("buy"), F.lit(-notional * (1 + slippage) * (1 + fee))).when(F.col("sell"), F.col("_units") * F.col("close") * ((1 - slippage) * (1 - fee))).otherwise(0.0)
    rows = rows.withColumn("_flow", flow)
    worth = F.lit(cash) + F.sum("_flow").over(past) + F.col("pos") * F.coalesce(F.col("_units"), F.lit(0.0)) * F.col("close")
    rows = rows.withColumn("equity", worth)
    return rows.withColumn("bar_return", F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(cash)) - 1).drop("_units", "_flow")


def buy_hold(frame: DataFrame, keys: tuple[str, ...] = GROUPS) -> DataFrame:
    """Positions that enter at the slice's first bar and leave at its last; one bar alone makes no trade."""
    w = ordered(keys)
    last = F.lead("timestamp").over(w).isNull()
    return frame.withColumn("pos", F.when(last, 0).otherwise(1))


def excess_returns(frame: DataFrame, keys: tuple[str, ...] = GROUPS, **costs) -> DataFrame:
    """frame (close, pos) with bar_return, base_return and excess over buying and holding with the same costs."""
    own = equity(frame, keys, **costs).drop("buy", "sell")
    base = equity(buy_hold(own.withColumnsRenamed({"equity": "own_equity", "bar_return": "own_return", "pos": "own_pos"}), keys), keys, **costs)
    base = base.drop("buy", "sell", "pos").withColumnsRenamed({"equity": "base_equity", "bar_return": "base_return"})
    base = base.withColumnsRenamed({"own_equity": "equity", "own_return": "bar_return", "own_pos": "pos"})
    return base.withColumn("excess", F.col("bar_return") - F.col("base_return"))


def trades(frame: DataFrame, keys: tuple[str, ...] = GROUPS) -> DataFrame:
    """One row for each closed trade of frame (close, pos): entry and exit time and close."""
    w = ordered(keys)
    before = F.coalesce(F.lag("pos").over(w), F.lit(0))
    rows = frame.withColumns({"_buy": (F.col("pos") == 1) & (before == 0), "_sell": (F.col("pos") == 0) & (before == 1)})
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"entry_at": F.last(F.when(F.col("_buy"), F.col("timestamp")), True).over(past), "entry_close": F.last(F.when(F.col("_buy"), F.col("close")), True).over(past)})
    return rows.where("_sell").select(*keys, "entry_at", F.col("timestamp").alias("exit_at"), "entry_close", F.col("close").alias("exit_close"))


def performance(curve: DataFrame, keys: tuple[str, ...] = GROUPS, cash: float = CASH, periods: int = BARS_A_YEAR) -> DataFrame:
    """Summary of equity curves: bars, orders, return, maximal drawdown, Sharpe ratio (null for no variation), end value."""
    past = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_peak", F.greatest(F.lit(cash), F.max("equity").over(past)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.sum((F.col("buy") | F.col("sell")).cast("long")).alias("orders"), F.sum(F.col("sell").cast("long")).alias("closed_trades"),
        F.max_by("equity", "timestamp").alias("end_value"), F.min(F.col("equity") / F.col("_peak") - 1).alias("max_drawdown"),
        F.avg("bar_return").alias("_m"), F.stddev_samp("bar_return").alias("_s"),
    )
    sharpe = F.try_divide(F.col("_m"), F.when(F.col("_s") > 1e-12, F.col("_s"))) * F.lit(periods**0.5)
    return out.withColumns({"total_return": F.col("end_value") / cash - 1, "sharpe": sharpe}).drop("_m", "_s")


def scan_thresholds(frame: DataFrame, factor: str, thresholds: list[float], fee: float = FEE, slippage: float = SLIPPAGE, funding: float = 0.0, latency: int = 0) -> DataFrame:
    """For each threshold, all-in: long from factor > threshold until factor <= threshold; an open trade is marked.

    Closed trades multiply the equity by C_x (1 - s)(1 - f) / (C_e (1 + s)(1 + f)). Nulls neither enter nor exit. Two bars of a
    market at one time raise in the plan.
    """
    if fee is None or slippage is None or funding or latency:
        raise ValueError("costs must be given; funding and latency are not modelled")
    levels = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    keys = (*GROUPS, "threshold")
    w = ordered(keys)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = frame.select(*GROUPS, "timestamp", "close", factor, levels)
    event = F.when(F.col(factor) > F.col("threshold"), 1).when(F.col(factor) <= F.col("threshold"), 0)
    again = F.lag("timestamp").over(w) == F.col("timestamp")
    rows = rows.withColumn("_e", F.when(again, F.raise_error(F.lit("two bars of a market at one time"))).otherwise(event)).withColumn("pos", F.coalesce(F.last("_e", True).over(past), F.lit(0)))
    before = F.coalesce(F.lag("pos").over(w), F.lit(0))
    rows = rows.withColumns({"_buy": (F.col("pos") == 1) & (before == 0), "_sell": (F.col("pos") == 0) & (before == 1)})
    step = F.when(F.col("_buy"), -F.ln("close") - F.lit(log((1 + slippage) * (1 + fee)))).when(F.col("_sell"), F.ln("close") + F.lit(log((1 - slippage) * (1 - fee))))
    out = rows.groupBy(*keys).agg(F.sum(F.coalesce(step, F.lit(0.0))).alias("_g"), F.sum(F.col("_buy").cast("long")).alias("entries"), F.sum(F.col("_sell").cast("long")).alias("exits"), F.max_by("pos", "timestamp").alias("_open"), F.max_by("close", "timestamp").alias("_c"))
    growth = F.col("_g") + F.when(F.col("_open") == 1, F.ln("_c")).otherwise(0.0)
    return out.select(*keys, "entries", "exits", (F.exp(growth) - 1).alias("total_return"))
