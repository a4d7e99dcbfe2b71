"""The factor catalog: 21 windowed and 7 bar-shape families, each lagged one completed bar inside its market."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.rolling import correlation, divided, full, had, lag, quotient, with_ewm
from quantloom.operators.prepare import clean_ohlcv, require_complete_grid
from quantloom.schemas import GROUPS

# Family names and default windows.
WINDOW_FAMILIES = (
    "momentum", "log_momentum", "ma_gap", "ema_gap", "return_volatility", "downside_volatility", "price_range",
    "donchian_position", "bollinger_z", "cutler_rsi", "volume_ratio", "volume_volatility", "dollar_volume",
    "volume_return_correlation", "parkinson_volatility", "efficiency_ratio", "amihud_proxy", "flow_proxy",
    "breakout_distance", "pullback_distance", "typical_price_gap",
)
BAR_FAMILIES = ("bar_body", "bar_range", "upper_wick", "lower_wick", "close_location", "true_range", "open_gap")
DEFAULT_WINDOWS = (6, 12, 24, 60, 120)


def _c(name: str) -> Column:
    return F.col(name)


Ratio = Callable[[Column, Column], Column]


def per_bar(frame: DataFrame, over: Ratio = divided) -> DataFrame:
    """Shared columns of one bar and the bar before, so that every rolling window reads them from one projection. over: the
    ratios whose divisor is a price, a volume or a mean of them; spreads divide by nothing but what is not 0."""
    before = frame.withColumns({"_p": lag("close"), "_pv": lag("volume")})
    c, h, low, v, p = (_c(x) for x in ("close", "high", "low", "volume", "_p"))
    ratio = over(c, p)
    log = F.ln(ratio)
    delta = c - p
    return before.withColumns({
        "_ret": ratio - 1, "_log": log, "_delta": delta, "_abs": F.abs(delta),
        "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "_loss2": F.when(log.isNotNull(), F.pow(F.least(log, F.lit(0.0)), 2)),
        "_dollar": c * v, "_vret": over(v, _c("_pv")) - 1,
        "_flow": divided(2 * c - h - low, h - low) * v, "_hl2": F.pow(F.ln(over(h, low)), 2),
        "_illiq": over(F.abs(ratio - 1), c * v), "_typical": (h + low + c) / 3,
    })


def windowed(family: str, w: int, full: Callable[[Callable, str, int], Column], over: Ratio = divided) -> Column:
    """A windowed formula at the current bar, over per_bar's columns; full gives an aggregate of a full window."""
    c = _c("close")
    if family in ("momentum", "log_momentum", "efficiency_ratio"):
        past = lag("close", w)
        if family == "efficiency_ratio":
            return divided(F.abs(c - past), full(F.sum, "_abs", w))
        return over(c, past) - 1 if family == "momentum" else F.ln(over(c, past))
    if family in ("ma_gap", "bollinger_z"):
        mean = full(F.avg, "close", w)
        return over(c, mean) - 1 if family == "ma_gap" else divided(c - mean, full(F.stddev_samp, "close", w))
    if family == "ema_gap":
        return over(c, _c(f"ewm_{w}")) - 1
    if family in ("price_range", "donchian_position"):
        top, bottom = full(F.max, "high", w), full(F.min, "low", w)
        return over(top - bottom, c) if family == "price_range" else divided(c - bottom, top - bottom)
    if family in ("volume_ratio", "volume_volatility"):
        mean = full(F.avg, "volume", w)
        return over(_c("volume") if family == "volume_ratio" else full(F.stddev_samp, "volume", w), mean)
    if family in ("breakout_distance", "pullback_distance"):
        return over(c, _c(f"_{'top' if family == 'breakout_distance' else 'bottom'}_{w}")) - 1
    simple = {
        "return_volatility": lambda: full(F.stddev_samp, "_log", w),
        "downside_volatility": lambda: F.sqrt(full(F.avg, "_loss2", w)),
        "cutler_rsi": lambda: divided(100 * full(F.sum, "_gain", w), full(F.sum, "_abs", w)),
        "dollar_volume": lambda: full(F.avg, "_dollar", w),
        "volume_return_correlation": lambda: correlation("_ret", "_vret", w),
        "parkinson_volatility": lambda: F.sqrt(full(F.avg, "_hl2", w) / (4 * math.log(2))),
        "amihud_proxy": lambda: full(F.avg, "_illiq", w),
        "flow_proxy": lambda: over(full(F.sum, "_flow", w), full(F.sum, "volume", w)),
        "typical_price_gap": lambda: over(c, full(F.avg, "_typical", w)) - 1,
    }
    return simple[family]()


def bar_shape(family: str, over: Ratio = divided) -> Column:
    o, h, low, c, p = (_c(x) for x in ("open", "high", "low", "close", "_p"))
    shapes = {
        "bar_body": over(c - o, o),
        "bar_range": over(h - low, c),
        "upper_wick": over(h - F.greatest(o, c), c),
        "lower_wick": over(F.least(o, c) - low, c),
        "close_location": divided(2 * c - h - low, h - low),
        "true_range": F.when(p.isNotNull(), over(F.greatest(h - low, F.abs(h - p), F.abs(low - p)), p)),
        "open_gap": over(o, p) - 1,
    }
    return shapes[family]


def standard_catalog(windows: Sequence[int] = DEFAULT_WINDOWS) -> list[tuple[str, int | None]]:
    """(family, window) of the whole catalog, in its declared order."""
    if not windows or len(set(windows)) != len(windows) or any(w < 3 for w in windows):
        raise ValueError("windows must be unique and at least three bars")
    return [(f, w) for f in WINDOW_FAMILIES for w in windows] + [(f, None) for f in BAR_FAMILIES]


def factor_name(family: str, window: int | None) -> str:
    known = WINDOW_FAMILIES if window is not None else BAR_FAMILIES
    if family not in known or (window is not None and window < 3):
        raise ValueError(f"unknown factor: {family}, {window}")
    return family if window is None else f"{family}_{window}"


def compute_factors(frame: DataFrame, specs: Sequence[tuple[str, int | None]], checked: bool = True, finite: bool = True) -> DataFrame:
    """frame with one column for each (family, window): the value of the last completed bar, null where not finite. With
    finite=False, meant for bars that were not checked, a price of 0 gives the infinity or NaN that IEEE division does.

    One shuffle by market serves all windows; ema_gap adds one by market and span of time, and carries means between spans. checked: clean bars on a complete grid
    are required.
    """
    names = [factor_name(*s) for s in specs]
    if len(set(names)) != len(names) or set(names) & set(frame.columns):
        raise ValueError("factor names must be unique and new")
    if checked:
        frame = require_complete_grid(clean_ohlcv(frame))
    columns, keys = frame.columns, [*GROUPS, "timestamp"]
    spans = tuple(sorted({w for f, w in specs if f == "ema_gap"}))
    ratio = divided if finite else quotient
    rows = per_bar(with_ewm(frame, "close", spans) if spans else frame, ratio)
    # The bar before stands in for the bar from here on, so that one lag serves all formulas.
    before = lag(F.struct(*(c for c in rows.columns if c not in keys))).alias("_before")
    rows = rows.select(*keys, F.struct(*(c for c in columns if c not in keys)).alias("_own"), before).select(*keys, "_own", "_before.*")
    prior = {f"_top_{w}": full(F.max, "high", w) for f, w in specs if f == "breakout_distance"} | {f"_bottom_{w}": full(F.min, "low", w) for f, w in specs if f == "pullback_distance"}
    if prior:
        rows = rows.withColumns(prior)
        rows = rows.withColumns({k: lag(k) for k in prior})
    shared: dict[tuple[str, int, str], Column] = {}

    def once(agg: Callable, x: str, w: int) -> Column:
        """An aggregate that several formulas may share, as a column of its own."""
        shared[x, w, agg.__name__] = full(agg, x, w, f"_had_{x}")
        return F.col(f"_of_{x}_{w}_{agg.__name__}")

    formulas = [(windowed(f, w, once, ratio) if w is not None else bar_shape(f, ratio)).alias(f"_{n}") for (f, w), n in zip(specs, names, strict=True)]
    if shared:
        rows = rows.withColumns({f"_had_{x}": had(x) for x, _, _ in shared}).withColumns({f"_of_{x}_{w}_{a}": v for (x, w, a), v in shared.items()})
    raw = rows.select(*keys, "_own", *formulas)
    own = [_c(c) if c in keys else _c(f"_own.{c}").alias(c) for c in columns]
    if not finite:
        return raw.select(*own, *(_c(f"_{n}").alias(n) for n in names))
    return raw.select(*own, *(F.expr(f"CASE WHEN abs(_{n}) < double('Infinity') THEN _{n} END").alias(n) for n in names))  # NaN is over all numbers


def lagged_return(lookback: int) -> Column:
    """Return over so many bars that ended a bar ago."""
    if lookback < 1:
        raise ValueError("lookback must be positive")
    return divided(lag("close", 1), lag("close", lookback + 1)) - 1


def with_lagged_mean(frame: DataFrame, w: int, name: str) -> DataFrame:
    """Mean of the w closes before the bar."""
    if w < 2:
        raise ValueError("window must be at least 2")
    return frame.withColumn("_before", lag("close")).withColumn(name, full(F.avg, "_before", w)).drop("_before")


def with_lagged_volatility(frame: DataFrame, w: int, name: str) -> DataFrame:
    """Sample deviation of the w log returns before the bar."""
    if w < 2:
        raise ValueError("window must be at least 2")
    steps = frame.withColumn("_l", F.ln(divided(F.col("close"), lag("close")))).withColumn("_l", lag("_l"))
    return steps.withColumn(name, full(F.stddev_samp, "_l", w)).drop("_l")


class FeaturePipeline:
    """Clean bars, then steps (functions of a DataFrame) in order."""

    def __init__(self, *steps):
        self.steps = steps

    def run(self, frame: DataFrame) -> DataFrame:
        out = clean_ohlcv(frame)
        for step in self.steps:
            out = out.transform(step)
        return out
