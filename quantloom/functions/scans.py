"""Running values of long series that no one task holds: each key's rows are cut into segments, windows run inside a segment,
and what earlier segments add up to is carried in from a table with a row for each key and segment.

A segment is any list of columns by which a key's rows are sorted first, such as a span of time (`span_of`) or of line numbers.
So a hot key is spread over as many tasks as it has segments, and one task sees no more of a key than a segment's rows or the
row of each of its segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_of(x: str | Column, width: int) -> Column:
    """The number of the span of so many units (microseconds of a timestamp) that holds x."""
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(width)).cast("long")


def with_carried(rows: DataFrame, carried: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with the other columns of carried, a row for each key and segment at most. Rows that are dealt out by these columns
    already are not moved; null keys meet nothing."""
    named = carried.withColumnsRenamed({c: f"_of_{c}" for c in columns})
    on = F.lit(True)
    for c in columns:
        on = on & (F.col(c) == F.col(f"_of_{c}"))
    return rows.join(named, on, "left").drop(*(f"_of_{c}" for c in columns))


def running_sums(frame: DataFrame, keys: Sequence[str], segments: dict[str, Column], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """frame with the running sum, own row included, of each column of sums over a key's rows by segments, then order.

    order must tell a segment's rows apart, or rows of equal order come in any order. Null values add nothing; a sum without
    any value is 0. Sums of integers are exact. Null keys are one key.
    """
    # A struct of a null is equal to itself, so that one partitioning serves windows and join.
    frame = frame.withColumns({f"_key_{k}": F.struct(k) for k in keys} | {f"_seg_{k}": F.struct(v) for k, v in segments.items()})
    place, keys = [f"_seg_{k}" for k in segments], [f"_key_{k}" for k in keys]
    own = [*keys, *place]
    zero = {k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    totals = frame.groupBy(*own).agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in zero.items()))
    earlier = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*own, *(F.sum(f"_sum_{k}").over(earlier).alias(f"_had_{k}") for k in sums))
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = frame.withColumns({k: F.sum(v).over(inside) for k, v in zero.items()})
    out = with_carried(local, carried, own)
    return out.withColumns({k: F.col(k) + F.coalesce(f"_had_{k}", F.lit(0)) for k in sums}).drop(*own, *(f"_had_{k}" for k in sums))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, width: int, ties: Sequence[str] = (), name: str = "found") -> DataFrame:
    """left with name, a struct of the last row of right of the same keys at or before left_time, null if there is none, and
    name_first.

    Of rows of right at one time the one of the largest ties is last. Each row of left gives one row. Null keys and null times
    meet nothing. name_first is the first row of right of the same keys at any time: where name is null, all are later.
    Both sides go through one union and one shuffle by keys and span of width microseconds, never through a join of rows; the
    last row of earlier spans is carried in.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own, others = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    at = F.struct(F.unix_micros(right_time).alias("at"), *ties)
    later = right.where(known & F.col(right_time).isNotNull()).select(*keys, F.unix_micros(right_time).alias("_at"), F.lit(0).alias("_own"), at.alias("_tie"), F.struct(*others).alias("_right"))
    later = later.withColumn("_span", span_of("_at", width))
    first = left.select(*keys, F.unix_micros(F.when(known, F.col(left_time))).alias("_at"), F.lit(1).alias("_own"), F.struct(*own).alias("_left")).withColumn("_span", span_of("_at", width))
    place = [*keys, "_span"]
    ends = later.groupBy(*place).agg(F.max_by("_right", "_tie").alias("_last"), F.min_by("_right", "_tie").alias("_head"))
    ends = ends.unionByName(first.select(*place).distinct(), allowMissingColumns=True).groupBy(*place).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_last", "_head")))
    by_span = Window.partitionBy(*keys).orderBy("_span")
    earlier, every = by_span.rowsBetween(Window.unboundedPreceding, -1), by_span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(*place, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"), F.first("_head", ignorenulls=True).over(every).alias("_head"))
    both = first.unionByName(later, allowMissingColumns=True)
    inside = Window.partitionBy(*place).orderBy("_at", "_own", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(inside)).where("_own = 1").select(*place, "_at", "_left", "_seen")
    out = with_carried(seen, carried, place)
    timed = F.col("_at").isNotNull()
    found = (F.when(timed, F.coalesce("_seen", "_carried")).alias(name), F.when(timed, F.col("_head")).alias(f"{name}_first"))
    return out.select(*(F.col(c) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns), *found)


#: What is older than this share of a recursive mean is left out: far under what a double tells apart.
NEGLIGIBLE = 1e-26


def with_recursive_means(frame: DataFrame, column: str, spans: Sequence[int], keys: Sequence[str], time: str, width: int) -> DataFrame:
    """frame with ewm_<s> for each span s: y = y_before + 2 / (s + 1) * (x - y_before) from the first value on, null for the
    first s - 1 values. Null values leave the mean as it is and have none. Rows of a key must differ in time, keys are not null.

    With r = 1 - 2 / (s + 1), the weighted sum of the last 2n values is that of the last n, plus r**n times the one n rows
    before: so a sum doubles its reach with each lag, in one window of a segment of width microseconds. A segment's row number
    weighs the mean that earlier segments carry in, which is found in the same way among segments.
    """
    own = [*keys, "_span"]
    rates = {s: 1 - 2 / (s + 1) for s in spans}
    steps = {s: 1 if not r else ceil(log2(log(NEGLIGIBLE) / log(r))) for s, r in rates.items()}
    part, by = ", ".join(f"`{c}`" for c in own), f"`{time}`"
    rows = frame.withColumn("_span", span_of(F.unix_micros(time), width))
    rows = rows.select("*", F.expr(f"count(`{column}`) OVER (PARTITION BY {part} ORDER BY {by} ROWS UNBOUNDED PRECEDING) AS _n"), *(F.expr(f"double(`{column}`) * {1 - r!r}D AS _s{s}") for s, r in rates.items()))
    for k in range(max(steps.values())):
        wider = {f"_s{s}": F.expr(f"CASE WHEN _s{s} IS NOT NULL THEN _s{s} + {r ** (1 << k)!r}D * coalesce(lag(_s{s}, {1 << k}) IGNORE NULLS OVER (PARTITION BY {part} ORDER BY {by}), 0D) END") for s, r in rates.items() if k < steps[s]}
        rows = rows.withColumns(wider)
    ends = rows.where("_n > 0").groupBy(*own).agg(F.max("_n").alias("_m"), F.min_by(F.col(column).cast("double"), F.when(F.col(column).isNotNull(), F.col(time))).alias("_first"), *(F.max_by(f"_s{s}", F.when(F.col(f"_s{s}").isNotNull(), F.col("_n"))).alias(f"_b{s}") for s in spans))
    line = f"(PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY _span)"
    ends = ends.select("*", F.expr(f"row_number() OVER {line} AS _k"), F.expr(f"sum(_m) OVER {line} - _m AS _had"))
    # The first segment's mean begins with its first value; other segments turn a mean m into a * m + b.
    ends = ends.withColumns({f"_a{s}": F.when(F.col("_k") == 1, 0.0).otherwise(F.pow(F.lit(r), "_m")) for s, r in rates.items()} | {f"_b{s}": F.when(F.col("_k") == 1, F.col(f"_b{s}") + F.pow(F.lit(r), "_m") * F.col("_first")).otherwise(F.col(f"_b{s}")) for s, r in rates.items()})
    for k in range(max(steps.values())):
        old = lambda x: f"lag({x}, {1 << k}) OVER {line}"  # noqa: B023, E731
        ends = ends.withColumns({f"_b{s}": F.expr(f"_b{s} + _a{s} * coalesce({old(f'_b{s}')}, 0D)") for s in spans if k < steps[s]} | {f"_a{s}": F.expr(f"_a{s} * coalesce({old(f'_a{s}')}, 0D)") for s in spans if k < steps[s]})
    carried = ends.select(*own, "_had", *(F.expr(f"coalesce(lag(_b{s}) OVER {line}, _first) AS _in{s}") for s in spans))
    out = with_carried(rows, carried, own)
    mean = {f"ewm_{s}": F.when((F.col("_had") + F.col("_n") >= s) & F.col(column).isNotNull(), F.col(f"_s{s}") + F.pow(F.lit(r), "_n") * F.col(f"_in{s}")) for s, r in rates.items()}
    return out.withColumns(mean).select(*frame.columns, *mean)
