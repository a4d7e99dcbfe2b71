"""Walk-forward factor and strategy studies: folds, holdouts, trial summaries, selection."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.simulate import excess_returns, positions
from quantloom.operators.stats import adjust_pvalues, block_bootstrap, spearman, summarize_ic
from quantloom.schemas import GROUPS
from quantloom.sources.store import written

LEAST_FOLD = 30


def bar_folds(bars: int, train: int, test: int, embargo: int, holdout: float) -> list[dict[str, int]]:
    """Test folds over bar numbers and the sealed holdout: the development end is trimmed by the embargo, too. The first fold
    must be whole; a last one of LEAST_FOLD bars counts."""
    sealed = int(bars * (1 - holdout))
    folds, at, end = [], train + embargo, sealed - embargo
    if at + test > end:
        raise ValueError("not enough bars for a whole fold")
    while at < end and min(at + test, end) - at >= LEAST_FOLD:
        folds.append({"fold": len(folds), "train_start": at - embargo - train, "train_end": at - embargo, "test_start": at, "test_end": min(at + test, end)})
        at += test
    return folds + [{"fold": -1, "train_start": 0, "train_end": sealed - embargo, "test_start": sealed, "test_end": bars}]


def time_folds(times: int, train: int, test: int, embargo: int) -> list[dict[str, int]]:
    """Folds over distinct times, a test width apart; only whole ones."""
    folds, at = [], 0
    while at + train + embargo + test <= times:
        folds.append({"fold": len(folds), "train_start": at, "train_end": at + train, "test_start": at + train + embargo, "test_end": at + train + embargo + test})
        at += test
    return folds


def holdout_times(times: int, test: int, fraction: float) -> int:
    return max(test, ceil(times * fraction))


def numbered(frame: DataFrame, name: str = "bar_no") -> DataFrame:
    """frame with the number of each row's time among its market's bars; on a complete panel, among all times."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*GROUPS).orderBy("timestamp")) - 1)


def fold_frame(frame: DataFrame, folds: Sequence[dict[str, int]]) -> DataFrame:
    return frame.sparkSession.createDataFrame([(f["fold"], f["train_start"], f["train_end"], f["test_start"], f["test_end"]) for f in folds], "fold int, train_start int, train_end int, test_start int, test_end int")


def fold_ics(frame: DataFrame, factors: Sequence[str], folds: Sequence[dict[str, int]], horizon: int = 1, min_assets: int = 3) -> DataFrame:
    """fold, phase, factor, timestamp, ic, n: all folds and factors in one job; labels never leave their phase."""
    rows = numbered(frame).withColumn("label", F.try_divide(F.lead("close", horizon).over(Window.partitionBy(*GROUPS).orderBy("timestamp")), F.col("close")) - 1)
    long = rows.select("timestamp", "bar_no", "label", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors))).alias("v")).select("timestamp", "bar_no", "label", "v.*")
    phases = [(f["fold"], p, f[f"{p}_start"], f[f"{p}_end"]) for f in folds for p in ("train", "test")]
    spans = F.broadcast(frame.sparkSession.createDataFrame(phases, "fold int, phase string, lo int, hi int"))  # a row for each fold
    inside = (F.col("bar_no") >= F.col("lo")) & (F.col("bar_no") + horizon < F.col("hi"))
    return spearman(long.join(spans, inside), "value", "label", ["fold", "phase", "factor", "timestamp"], min_assets)


def select_factors(train: DataFrame, factors: Sequence[str], alpha: float) -> DataFrame:
    """fold, selected: the eligible factor of largest absolute mean IC, the first declared wins ties; null if none."""
    place = F.array_position(F.array(*map(F.lit, factors)), F.col("factor"))
    good = (F.col("adjusted") <= alpha) & F.col("mean_ic").isNotNull()
    return train.groupBy("fold").agg(F.max_by(F.when(good, F.col("factor")), F.struct(good, F.when(good, F.abs("mean_ic")), -place)).alias("selected"))


def walk_forward(frame: DataFrame, factors: Sequence[str], train: int, test: int, horizon: int = 1, embargo: int = 1, min_assets: int = 3, resamples: int = 199, block: int = 3, seed: int = 7, alpha: float = 0.05, method: str = "fdr_bh") -> DataFrame:
    """fold, factor, mean_ic, ir, periods, p, adjusted, selected, test_ic of every fold and factor."""
    if embargo < horizon:
        raise ValueError("the embargo must cover the horizon")
    times = frame.select("timestamp").distinct().count()
    folds = time_folds(times, train, test, embargo)
    ics = written(fold_ics(frame, factors, folds, horizon, min_assets), "fold-ics")
    trained, tested = ics.where("phase = 'train'"), ics.where("phase = 'test'")
    p = block_bootstrap(trained, ["fold", "factor"], "ic", "timestamp", block, resamples, seed)
    summary = adjust_pvalues(summarize_ic(trained, ["fold", "factor"]).join(p, ["fold", "factor"]), method, ["fold"])
    chosen = select_factors(summary, factors, alpha)
    out = summarize_ic(tested, ["fold", "factor"]).select("fold", "factor", F.col("mean_ic").alias("test_ic"))
    return summary.join(chosen, "fold").join(out, ["fold", "factor"], "left").withColumn("selected", F.coalesce(F.col("selected") == F.col("factor"), F.lit(False)))


def factor_study(frame: DataFrame, factors: Sequence[str], train: int, test: int, holdout: float = 0.2, **kwargs) -> DataFrame:
    """The walk-forward table over development times, and the last fold's choice evaluated once on the sealed holdout. The
    factors are computed once: the panel is written, with the columns that the study needs alone."""
    frame = written(frame.select(*GROUPS, "timestamp", "close", *factors), "study-panel")
    rows = numbered(frame, "_n")
    times = frame.select("timestamp").distinct().count()
    sealed = times - holdout_times(times, test, holdout)
    table = written(walk_forward(rows.where(F.col("_n") < sealed).drop("_n"), factors, train, test, **kwargs), "walk-forward")
    choice = F.max_by(F.struct("fold", F.when(F.col("selected"), F.col("factor")).alias("factor")), F.struct("fold", F.col("selected").cast("int")))
    last, *row = table.agg(choice.alias("last")).select("last.*").first()
    if row == [None]:
        return table.withColumn("holdout_ic", F.lit(None).cast("double"))
    fold = {"fold": 0, "train_start": 0, "train_end": 0, "test_start": sealed, "test_end": times}
    sealed_ic = summarize_ic(fold_ics(frame, [row[0]], [fold], kwargs.get("horizon", 1), kwargs.get("min_assets", 3)).where("phase = 'test'"), ["factor"])
    return table.join(sealed_ic.select("factor", F.lit(last).alias("fold"), F.col("mean_ic").alias("holdout_ic")), ["fold", "factor"], "left")


def factor_ic_blocks(frame: DataFrame, factors: Sequence[str], folds: Sequence[dict[str, int]], block: int, least: int | None = None) -> DataFrame:
    """symbol, factor, fold, block_no, ic, n: time-series rank correlation with the next return in blocks inside test folds.

    A block counts if the bar after its last one is still in the fold, and has max(10, block / 2) pairs (or so many as told).
    """
    rows = numbered(frame).withColumn("label", F.try_divide(F.lead("close", 1).over(Window.partitionBy(*GROUPS).orderBy("timestamp")), F.col("close")) - 1)
    long = rows.select("symbol", "bar_no", "label", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors))).alias("v")).select("symbol", "bar_no", "label", "v.*")
    spans = F.broadcast(fold_frame(frame, [f for f in folds if f["fold"] >= 0]).select("fold", "test_start", "test_end"))  # a row for each fold
    inside = long.join(spans, (F.col("bar_no") >= F.col("test_start")) & (F.col("bar_no") < F.col("test_end")))
    inside = inside.withColumn("block_no", ((F.col("bar_no") - F.col("test_start")) / block).cast("int"))
    inside = inside.where(F.col("test_start") + (F.col("block_no") + 1) * block < F.col("test_end"))
    return spearman(inside, "value", "label", ["symbol", "factor", "fold", "block_no"], least or max(10, block // 2))


def strategy_trials(features: DataFrame, strategies: dict, folds: Sequence[dict[str, int]], block: int, resamples: int, seed: int = 7) -> DataFrame:
    """strategy, mean_excess, bars, orders, p over all test folds and markets; each fold starts flat and ends flat."""
    rows = numbered(features)
    spans = F.broadcast(fold_frame(features, [f for f in folds if f["fold"] >= 0]).select("fold", "test_start", "test_end"))  # a row for each fold
    known = lambda x: F.coalesce(x, F.lit(False))
    each = [F.struct(F.lit(name).alias("strategy"), *(known(x).alias(c) for x, c in zip(s.conditions(), ("entry", "exit"), strict=True))) for name, s in strategies.items()]
    every = rows.select(*GROUPS, "timestamp", "close", "bar_no", F.explode(F.array(*each)).alias("_s")).select(*GROUPS, "timestamp", "close", "bar_no", "_s.*")
    inside = every.join(spans, (F.col("bar_no") >= F.col("test_start")) & (F.col("bar_no") < F.col("test_end")))
    keys = (*GROUPS, "strategy", "fold")
    held = excess_returns(positions(inside, keys), keys)
    moved = (F.col("pos") != F.coalesce(F.lag("pos").over(Window.partitionBy(*keys).orderBy("timestamp")), F.lit(0))).cast("long")
    held = written(held.select(*keys, "timestamp", "excess", moved.alias("_order")), "strategy-returns")
    total = held.groupBy("strategy").agg(F.avg("excess").alias("mean_excess"), F.count("*").alias("bars"), F.sum("_order").alias("orders"))
    p = block_bootstrap(held, ["strategy"], "excess", "timestamp", block, resamples, seed, least=10, segments=["symbol", "fold"])
    return total.join(p, "strategy")


def select_strategy(trials: DataFrame, alpha: float) -> DataFrame:
    """trials (strategy, mean_excess, adjusted) with selected: the largest mean among those above 0 whose adjusted p reaches
    alpha; equal means go by name; none if no trial qualifies."""
    good = (F.col("adjusted") <= alpha) & (F.col("mean_excess") > 0)
    top = trials.where(good).orderBy(F.col("mean_excess").desc(), "strategy").limit(1).select(F.col("strategy").alias("_best"))
    return trials.join(F.broadcast(top), F.col("strategy") == F.col("_best"), "left").withColumn("selected", F.col("_best").isNotNull()).drop("_best")  # one row


def factor_trials(blocks: DataFrame, resamples: int, seed: int, method: str = "bonferroni") -> DataFrame:
    """factor, blocks, mean_ic, ir, p, adjusted over all blocks (symbol, factor, fold, block_no, ic): p of a two-sided test by
    blocks of three in the order of symbol, fold and block."""
    order = blocks.withColumn("_o", F.struct("symbol", "fold", "block_no"))
    p = block_bootstrap(order, ["factor"], "ic", "_o", 3, resamples, seed, least=10)
    out = summarize_ic(blocks, ["factor"]).withColumnRenamed("periods", "blocks").join(p, "factor")
    return adjust_pvalues(out.withColumn("_family", F.lit(1)), method, ["_family"]).drop("_family")


def notable(trials: DataFrame, score, name: str, top: int) -> DataFrame:
    """The top rows by score with their place from 1; ties by name. Trials are few rows: one for each factor or strategy."""
    best = trials.withColumn("_s", score).orderBy(F.col("_s").desc_nulls_last(), name).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("_s").desc_nulls_last(), name))).drop("_s")


def holdout_series_ic(frame: DataFrame, factor: str, fraction: float) -> DataFrame:
    """symbol, ic, n: rank correlation over the last bars of each market (the holdout) of the factor at a bar with the return
    from the next close to the one after."""
    w = Window.partitionBy(*GROUPS).orderBy("timestamp")
    later = F.try_divide(F.lead("close", 2).over(w), F.lead("close", 1).over(w)) - 1
    rows = numbered(frame).withColumns({"_later": later, "_bars": F.count("*").over(Window.partitionBy(*GROUPS))})
    return spearman(rows.where(F.col("bar_no") >= F.floor(F.col("_bars") * (1 - fraction))), factor, "_later", ["symbol"], 3)
