"""Rule-based long/cash strategies as entry and exit columns over lagged factors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.schemas import market_window

#: kind -> (parameters, factor columns)
KINDS = {
    "momentum": (("window", "threshold"), ("momentum_{window}",)),
    "reversal": (("window", "threshold"), ("momentum_{window}",)),
    "ma_trend": (("window", "threshold"), ("ma_gap_{window}",)),
    "ema_trend": (("window", "threshold"), ("ema_gap_{window}",)),
    "ma_cross": (("fast", "slow"), ("ma_gap_{fast}", "ma_gap_{slow}")),
    "ema_cross": (("fast", "slow"), ("ema_gap_{fast}", "ema_gap_{slow}")),
    "bollinger_revert": (("window", "entry", "exit"), ("bollinger_z_{window}",)),
    "bollinger_breakout": (("window", "entry", "exit"), ("bollinger_z_{window}",)),
    "rsi_revert": (("window", "entry", "exit"), ("cutler_rsi_{window}",)),
    "donchian_breakout": (("window", "exit_position"), ("breakout_distance_{window}", "donchian_position_{window}")),
    "channel_revert": (("window", "entry", "exit"), ("donchian_position_{window}",)),
    "momentum_volume": (("window", "volume_window", "min_volume_ratio"), ("momentum_{window}", "volume_ratio_{volume_window}")),
    "momentum_low_vol": (("window", "vol_window", "max_volatility"), ("momentum_{window}", "return_volatility_{vol_window}")),
    "body_followthrough": (("minimum",), ("bar_body",)),
    "wide_range_breakout": (("range_minimum", "location_minimum"), ("bar_range", "close_location")),
}

WINDOWS = ("window", "fast", "slow", "volume_window", "vol_window")


@dataclass(frozen=True)
class Strategy:
    """A kind with its parameters; windows are integers of at least 3, fast is under slow, the others are numbers."""

    kind: str
    params: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")
        if set(self.params) != set(KINDS[self.kind][0]):
            raise ValueError(f"{self.kind} takes {KINDS[self.kind][0]}")
        for name, value in self.params.items():
            if isinstance(value, bool) or not isinstance(value, int | float) or value != value or abs(value) == float("inf"):
                raise ValueError(f"{name} must be a finite number")
            if name in WINDOWS and (not isinstance(value, int) or value < 3):
                raise ValueError(f"{name} must be an integer of at least 3")
        if "fast" in self.params and self.params["fast"] >= self.params["slow"]:
            raise ValueError("fast must be under slow")

    def factors(self) -> tuple[str, ...]:
        return tuple(x.format(**self.params) for x in KINDS[self.kind][1])

    def conditions(self) -> tuple[Column, Column]:
        """Entry and exit, null where a factor is null."""
        p, f = self.params, [F.col(x) for x in self.factors()]
        a, b = f[0], f[-1]
        if self.kind in ("momentum", "ma_trend", "ema_trend"):
            return a > p["threshold"], ~(a > p["threshold"])
        if self.kind in ("ma_cross", "ema_cross"):
            return a < b, ~(a < b)
        simple = {
            "reversal": lambda: (a < -p["threshold"], a >= 0),
            "bollinger_revert": lambda: (a < p["entry"], a >= p["exit"]),
            "bollinger_breakout": lambda: (a > p["entry"], a <= p["exit"]),
            "rsi_revert": lambda: (a < p["entry"], a >= p["exit"]),
            "donchian_breakout": lambda: (a > 0, b < p["exit_position"]),
            "channel_revert": lambda: (a < p["entry"], a >= p["exit"]),
            "momentum_volume": lambda: ((a > 0) & (b > p["min_volume_ratio"]), a <= 0),
            "momentum_low_vol": lambda: ((a > 0) & (b < p["max_volatility"]), a <= 0),
            "body_followthrough": lambda: (a > p["minimum"], a <= 0),
            "wide_range_breakout": lambda: ((a > p["range_minimum"]) & (b > p["location_minimum"]), b <= 0),
        }
        return simple[self.kind]()

    def signals(self, features: DataFrame, entry: str = "entry", exit_: str = "exit") -> DataFrame:
        """features with both columns; unknown is false on either side."""
        go, stop = (F.coalesce(x, F.lit(False)) for x in self.conditions())
        return features.withColumns({entry: go, exit_: stop})


def execution_target(lookback: int) -> Column:
    """Whether the return over so many bars up to the bar before is above 0: the target filled at this bar's close."""
    if lookback < 2:
        raise ValueError("lookback must be at least two bars")
    w = market_window()
    return F.coalesce(F.try_divide(F.lag("close", 1).over(w), F.lag("close", lookback + 1).over(w)) - 1 > 0, F.lit(False))


def needed_factors(strategies: list[Strategy]) -> list[tuple[str, int | None]]:
    """(family, window) of all factor columns that the strategies read."""
    out: dict[tuple[str, int | None], None] = {}
    for s in strategies:
        for name in s.factors():
            family, _, w = name.rpartition("_")
            out[(family, int(w)) if w.isdigit() else (name, None)] = None
    return list(out)
