"""Rank correlations, information coefficients, corrections for multiple tests, block bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scans import running_sums
from quantloom.schemas import GROUPS, finite, market_window
from quantloom.sources.store import written


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank of x inside the keys, ties at their mean."""
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (ties - 1) / F.lit(2.0)


def spearman(rows: DataFrame, x: str, y: str, keys: list[str], least: int) -> DataFrame:
    """keys, ic, n: rank correlation for each key with at least so many finite pairs; constant sides are left out."""
    good = rows.where(finite(F.col(x)) & finite(F.col(y)))
    ranks = good.select(*keys, average_rank(x, keys).alias("_a"), average_rank(y, keys).alias("_b"))
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    out = ranks.groupBy(*keys).agg(F.try_divide(F.covar_pop("_a", "_b"), F.when(spread > 1e-12, spread)).alias("ic"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull())


def forward_return(horizon: int = 1) -> Column:
    """Return of the next so many bars; filter to a fold before using it, or the label crosses its end."""
    return F.try_divide(F.lead("close", horizon).over(market_window()), F.col("close")) - 1


def ic_series(frame: DataFrame, factor: str, horizon: int = 1, min_assets: int = 3) -> DataFrame:
    """timestamp, ic, n of the cross-sections of a frame of one timeframe; more than one raises in the plan."""
    if horizon < 1 or min_assets < 3:
        raise ValueError("horizon must be 1 or more, min_assets 3 or more")
    frames = F.count_distinct("timeframe")
    one = frame.agg(F.when(frames > 1, F.raise_error(F.lit("more than one timeframe"))).otherwise(F.lit(1)).alias("_one"))
    frame = frame.crossJoin(F.broadcast(one)).where("_one = 1").drop("_one")  # one row
    rows = frame.select(*GROUPS, "timestamp", "close", factor).withColumn("_label", forward_return(horizon))
    return spearman(rows, factor, "_label", ["timestamp"], min_assets)


def summarize_ic(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """mean_ic, ir (mean / sample deviation, null for one value or no variation) and periods."""
    spread = F.stddev_samp("ic")
    return series.groupBy(*(keys or [])).agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.when(spread > 1e-12, spread)).alias("ir"), F.count("*").alias("periods"))


def adjust_pvalues(rows: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """rows (p) with adjusted, inside each family that the keys name; families are lists of trials. A p outside 0 to 1 or one
    that is unknown raises in the plan."""
    p = F.col("p")
    rows = rows.withColumn("p", F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("p must be from 0 to 1"))))
    family = Window.partitionBy(*keys)
    size = F.count("*").over(family)
    if method == "bonferroni":
        return rows.withColumn("adjusted", F.least(F.lit(1.0), F.col("p") * size))
    if method != "fdr_bh":
        raise ValueError(f"unknown method: {method}")
    ranked = rows.withColumn("_rank", F.row_number().over(family.orderBy("p"))).withColumn("_m", size)
    tail = family.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col("p") * F.col("_m") / F.col("_rank")).over(tail))).drop("_rank", "_m")


def block_means(series: DataFrame, keys: list[str], value: str, order: str, block: int, resamples: int, seed: int, centred: bool, segments: Sequence[str] = ()) -> DataFrame:
    """keys, r, mean, observed, n: means of circular block resamples of each key's series.

    Block starts come from md5('seed|r|k'), so that any engine draws the same. The resamples are spread over the cluster, and
    block sums are differences of prefix sums. A series that no task can hold is cut into segments: columns by which it is
    sorted before order.
    """
    good = series.where(finite(F.col(value))).select(*keys, *(F.col(c).alias(f"_by_{k}") for k, c in enumerate(segments)), F.col(order).alias("_order"), F.col(value).alias("_v"))
    good = written(good, "series")
    whole = good.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("observed"))  # a row for each series
    rows = good.join(whole, keys).withColumn("_v", F.col("_v") - F.col("observed") if centred else F.col("_v"))
    rows = running_sums(rows, keys, {str(k): F.col(f"_by_{k}") for k in range(len(segments))}, ["_order"], {"_i": F.lit(1), "_upto": F.col("_v")})
    rows = rows.withColumn("_i", F.col("_i") - 1).withColumn("_before", F.col("_upto") - F.col("_v")).withColumn("_all", F.when(F.col("_i") == F.col("n") - 1, F.col("_upto")))
    shape = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first("observed").alias("observed"), F.max("_all").alias("_all"))
    shape = shape.where(F.col("n") >= block)
    draws = shape.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n + {block} - 1) div {block} as int) - 1"))))
    word = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r"), F.col("_draw")).cast("binary")), 1, 8)
    draws = draws.withColumn("_from", F.conv(word, 16, 10).cast("long") % F.col("n"))
    draws = draws.withColumn("_len", F.least(F.lit(block), F.col("n") - F.col("_draw") * block)).withColumn("_to", F.col("_from") + F.col("_len"))
    wrap = F.col("_to") >= F.col("n")
    draws = draws.withColumn("_end", F.when(wrap, F.col("_to") - F.col("n")).otherwise(F.col("_to"))).withColumn("_wrap", wrap.cast("int"))
    at = rows.select(*keys, F.col("_i").alias("_p"), F.col("_before").alias("_b"))
    one = draws.join(at.withColumnsRenamed({"_p": "_from", "_b": "_low"}), [*keys, "_from"])
    two = one.join(at.withColumnsRenamed({"_p": "_end", "_b": "_high"}), [*keys, "_end"])
    total = F.sum(F.col("_high") - F.col("_low") + F.col("_wrap") * F.col("_all"))
    return two.groupBy(*keys, "r").agg((total / F.first("n")).alias("mean"), F.first("observed").alias("observed"), F.first("n").alias("n"))


def block_bootstrap(series: DataFrame, keys: list[str], value: str, order: str, block: int, resamples: int, seed: int, least: int = 5, two_sided: bool = True, segments: Sequence[str] = ()) -> DataFrame:
    """keys, p: (exceed + 1) / (resamples + 1) of centred circular block resamples; 1 for short series."""
    if resamples < 99:
        raise ValueError("at least 99 resamples")
    means = block_means(series, keys, value, order, block, resamples, seed, centred=True, segments=segments)
    beyond = F.abs("mean") >= F.abs("observed") - 1e-15 if two_sided else F.col("mean") >= F.col("observed") - 1e-15
    p = means.groupBy(*keys).agg(F.when(F.first("n") >= max(least, 2 * block), (F.count_if(beyond) + 1) / F.lit(resamples + 1)).alias("p"))
    every = series.select(*keys).distinct()
    return every.join(p, keys, "left").withColumn("p", F.coalesce("p", F.lit(1.0)))


def block_interval(series: DataFrame, keys: list[str], value: str, order: str, block: int, resamples: int, seed: int) -> DataFrame:
    """keys, low, high: 2.5 and 97.5 % of the resampled means, linear between order statistics."""
    means = block_means(series, keys, value, order, block, resamples, seed, centred=False)
    return means.groupBy(*keys).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
