"""Cleaning, alignment to grids, adjustments, calendars and keyed merges of panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.schemas import GROUPS, KEYS, PRICES, finite, interval_ms, market_window, require_columns


def any_null(columns) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def invalid_bar() -> Column:
    """True for a bar that cleaning rejects: a price not above 0, volume below 0, crossed extremes, a non-finite value."""
    o, h, low, c, v = (F.col(x) for x in (*PRICES, "volume"))
    wrong = (h < F.greatest(o, c, low)) | (low > F.least(o, c, h)) | (v < 0)
    for x in PRICES:
        wrong = wrong | (F.col(x) <= 0)
    for x in (*PRICES, "volume"):
        wrong = wrong | ~finite(F.col(x))
    return F.coalesce(wrong, F.lit(True))


def keep_last_observed(frame: DataFrame, kind: str = "ohlcv", *ties: str) -> DataFrame:
    """One row for each key: the last observed; ties by the given columns, largest last."""
    order = [F.col("observed_at").desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in ties)]
    keyed = Window.partitionBy(*KEYS[kind]).orderBy(*order)
    return frame.withColumn("_k", F.row_number().over(keyed)).where("_k = 1").drop("_k")


def duplicate_keys(frame: DataFrame, kind: str = "ohlcv") -> DataFrame:
    return frame.groupBy(*KEYS[kind]).count().where("count > 1")


def require_clean(frame: DataFrame, duplicates: str, further: dict[str, Column] | None = None) -> None:
    """Raise on nulls, invalid bars, what else is told and, unless last_observed, duplicate keys: one aggregation by key."""
    require_columns(frame, KEYS["ohlcv"] + PRICES + ("volume", "observed_at"))
    if duplicates not in ("error", "last_observed"):
        raise ValueError(f"unknown policy: {duplicates}")
    tests = {"rows with nulls": any_null(frame.columns), "invalid bars": invalid_bar(), **(further or {})}
    per = frame.groupBy(*KEYS["ohlcv"]).agg(F.count("*").alias("_n"), *(F.count_if(v).alias(f"_t{k}") for k, v in enumerate(tests.values())))
    got = per.agg(*(F.coalesce(F.sum(f"_t{k}"), F.lit(0)) for k in range(len(tests))), F.count_if(F.col("_n") > 1)).first()
    found = {name: n for name, n in zip((*tests, "duplicate keys"), got, strict=True) if n and (name != "duplicate keys" or duplicates == "error")}
    if found:
        raise ValueError(", ".join(f"{n} {name}" for name, n in found.items()))


def clean_ohlcv(frame: DataFrame, duplicates: str = "error") -> DataFrame:
    """The frame with unique keys and only valid bars; raises on nulls, invalid bars and, unless last_observed, duplicates."""
    require_clean(frame, duplicates)
    return keep_last_observed(frame) if duplicates == "last_observed" else frame


def grid_times(start: int, end: int, step: int) -> Column:
    """A row for each time of the half-open [start, end)."""
    return F.explode(F.transform(F.sequence(F.lit(start), F.lit(end - 1), F.lit(step)), F.timestamp_millis))


def align_ohlcv(frame: DataFrame, start: int, end: int, interval: str, missing: str = "leave_null") -> DataFrame:
    """Every market on the whole grid [start, end) in epoch ms, an interval begun before the end included. forward_close fills
    a gap with the last close and volume 0 and marks it; leading gaps stay null and unmarked.

    The frame is held to the rules of clean_ohlcv. A window that is empty or does not start on the interval's grid raises, and
    so do bars outside it or off its grid; all bars are tested in one pass.
    """
    step = interval_ms(interval)
    if end <= start or start % step:
        raise ValueError("the window is empty or starts off the grid")
    if missing not in ("leave_null", "forward_close"):
        raise ValueError(f"unknown policy: {missing}")
    ms = F.unix_millis("timestamp")
    outside = (ms < start) | (ms >= end) | (F.pmod(ms - start, F.lit(step)) != 0)
    require_clean(frame, "error", {"bars outside the window or off its grid": outside})
    grid = frame.select(*GROUPS).distinct().withColumn("timestamp", grid_times(start, end, step))
    full = grid.join(frame, [*GROUPS, "timestamp"], "left")
    if missing == "leave_null":
        return full.withColumn("is_imputed", F.lit(False))
    past = market_window().rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("_last", F.last("close", ignorenulls=True).over(past))
    gap = F.col("close").isNull() & F.col("_last").isNotNull()
    fills = {c: F.when(gap, F.col("_last")).otherwise(F.col(c)) for c in PRICES}
    return full.withColumns({**fills, "volume": F.when(gap, F.lit(0.0)).otherwise(F.col("volume")), "is_imputed": gap}).drop("_last")


def adjustment_violations(frame: DataFrame, factors: DataFrame) -> DataFrame:
    """uncovered, future_known, bad_factor, duplicates: how often factors (exchange, symbol, timestamp, known_at,
    price_factor, volume_factor) break the rules; knowledge may not be later than the bar, to the microsecond."""
    keys = ["exchange", "symbol", "timestamp"]
    joined = frame.select(*keys).join(factors.select(*keys, "known_at", "price_factor", "volume_factor"), keys, "left")
    good = finite(F.col("price_factor")) & finite(F.col("volume_factor")) & (F.col("price_factor") > 0) & (F.col("volume_factor") > 0)
    counts = joined.agg(
        F.count_if(F.col("known_at").isNull()).alias("uncovered"),
        F.count_if(F.unix_micros("known_at") > F.unix_micros("timestamp")).alias("future_known"),
        F.count_if(F.col("known_at").isNotNull() & ~F.coalesce(good, F.lit(False))).alias("bad_factor"),
    )
    again = factors.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("duplicates"))
    return counts.crossJoin(again)  # one row each


def apply_adjustments(frame: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices and volume times the factors of their bar; raises on any violation."""
    found = adjustment_violations(frame, factors).first().asDict()
    if any(found.values()):
        raise ValueError(f"adjustments rejected: {found}")
    both = frame.join(factors.drop("exchange_timestamp"), ["exchange", "symbol", "timestamp"], "left")
    scaled = {c: F.col(c) * F.col("price_factor") for c in PRICES}
    return both.withColumns({**scaled, "volume": F.col("volume") * F.col("volume_factor")}).drop("known_at", "price_factor", "volume_factor")


def calendar(frame: DataFrame, eligibility: DataFrame, start: int, end: int, interval: str) -> DataFrame:
    """symbol, timestamp, status of the grid: outside_eligibility, observed or missing; eligibility outranks presence."""
    step = interval_ms(interval)
    if end <= start or start % step:
        raise ValueError("the window is empty or starts off the grid")
    grid = eligibility.select("symbol", "eligible_from", "eligible_until", grid_times(start, end, step).alias("timestamp"))
    seen = frame.select("symbol", "timestamp").distinct().withColumn("seen", F.lit(True))
    inside = (F.col("timestamp") >= F.col("eligible_from")) & (F.col("timestamp") < F.col("eligible_until"))
    status = F.when(~inside, "outside_eligibility").when(F.coalesce("seen", F.lit(False)), "observed").otherwise("missing")
    return grid.join(seen, ["symbol", "timestamp"], "left").select("symbol", "timestamp", status.alias("status"))


def complete_grid_violations(frame: DataFrame) -> DataFrame:
    """Interior gaps: rows whose next row in the market is not one interval later."""
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}.items() for x in kv)), F.substring("timeframe", -1, 1))
    step = F.expr("cast(substring(timeframe, 1, length(timeframe) - 1) as bigint)") * unit
    after = F.lead("timestamp").over(market_window())
    gap = F.unix_millis(after) - F.unix_millis("timestamp")
    return frame.select(*GROUPS, "timestamp", gap.alias("gap_ms"), step.alias("step_ms")).where("gap_ms <> step_ms")


def require_complete_grid(frame: DataFrame) -> DataFrame:
    if "is_imputed" in frame.columns and not frame.where("is_imputed").isEmpty():
        raise ValueError("imputed bars")
    if not complete_grid_violations(frame).isEmpty():
        raise ValueError("incomplete grid")
    return frame


def keyed_merge(old: DataFrame, new: DataFrame, kind: str = "ohlcv") -> DataFrame:
    """Union with relaxed columns, the last observed row of each key stays; equal times: the newer batch wins."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last_observed(both, kind, "_batch").drop("_batch")


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Equal as multisets of rows."""
    other = other.select(*one.columns)
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
