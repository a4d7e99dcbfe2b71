"""Rolling functions over a market's bars that are null until their window is full of non-null values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scans import with_recursive_means
from quantloom.schemas import GROUPS, market_window


def over(w: int | None = None) -> str:
    """SQL of a market's window in time order, of the last w rows if told. Whole expressions as SQL take one call to the JVM
    each, where columns put together piece by piece take dozens: a catalog has hundreds of them."""
    rows = "" if w is None else f" ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW"
    return f"(PARTITION BY {', '.join(GROUPS)} ORDER BY timestamp{rows})"


def full(agg: Callable[[str], Column], x: str, w: int, counted: str | None = None) -> Column:
    """An aggregate function of functions, over the last w values of the column x. counted: a column of how many values of x the
    market has had so far (`had`), so that the window need not be counted anew for each bar."""
    count = f"count({x}) OVER {over(w)}" if counted is None else f"{counted} - coalesce(lag({counted}, {w}) OVER {over()}, 0)"
    return F.expr(f"CASE WHEN {count} = {w} THEN {agg.__name__}({x}) OVER {over(w)} END")


def had(x: str) -> Column:
    return F.expr(f"count({x}) OVER (PARTITION BY {', '.join(GROUPS)} ORDER BY timestamp ROWS UNBOUNDED PRECEDING)")


def lag(x: str | Column, k: int = 1) -> Column:
    return F.expr(f"lag({x}, {k}) OVER {over()}") if isinstance(x, str) else F.lag(x, k).over(market_window())


def divided(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: infinite where b is 0, NaN where both are."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def correlation(x: str, y: str, w: int) -> Column:
    """Pearson correlation of w joint values; null where a side is constant."""
    a, b = (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {c} END" for c in (x, y))
    spread = f"stddev_samp({a}) OVER {over(w)} * stddev_samp({b}) OVER {over(w)}"
    return F.expr(f"CASE WHEN count({a}) OVER {over(w)} = {w} THEN try_divide(covar_samp({a}, {b}) OVER {over(w)}, CASE WHEN {spread} > 1e-12 THEN {spread} END) END")


#: A market's recursive means run in spans of so many microseconds (ten days), in as many tasks.
EWM_SPAN = 864_000_000_000


def with_ewm(frame: DataFrame, column: str, windows: tuple[int, ...], width: int = EWM_SPAN) -> DataFrame:
    """frame with ewm_<w>: the recursive mean with span w from the market's first bar, null for the first w - 1 bars."""
    return with_recursive_means(frame, column, windows, GROUPS, "timestamp", width)
