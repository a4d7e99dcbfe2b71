"""Signals, simulations, rank correlations and studies over event bars, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import signals, simulate, stats, study
from quantloom.plans.panel_queries import bars_sql, factor_frame, factors_cte, t_ms, with_sql
from quantloom.plans.registry import query
from quantloom.schemas import GROUPS
from quantloom.sources.bars import event_bars

S = signals.Strategy
STRATEGIES = {
    "momentum": (S("momentum", {"window": 6, "threshold": 0.0}), "momentum_6 > 0", "NOT momentum_6 > 0"),
    "reversal": (S("reversal", {"window": 6, "threshold": 0.5}), "momentum_6 < -0.5", "momentum_6 >= 0"),
    "ma_trend": (S("ma_trend", {"window": 12, "threshold": 0.1}), "ma_gap_12 > 0.1", "NOT ma_gap_12 > 0.1"),
    "ema_trend": (S("ema_trend", {"window": 12, "threshold": 0.1}), "ema_gap_12 > 0.1", "NOT ema_gap_12 > 0.1"),
    "ma_cross": (S("ma_cross", {"fast": 6, "slow": 24}), "ma_gap_6 < ma_gap_24", "NOT ma_gap_6 < ma_gap_24"),
    "ema_cross": (S("ema_cross", {"fast": 6, "slow": 24}), "ema_gap_6 < ema_gap_24", "NOT ema_gap_6 < ema_gap_24"),
    "bollinger_revert": (S("bollinger_revert", {"window": 12, "entry": -1.0, "exit": 0.0}), "bollinger_z_12 < -1", "bollinger_z_12 >= 0"),
    "bollinger_breakout": (S("bollinger_breakout", {"window": 12, "entry": 1.0, "exit": 0.0}), "bollinger_z_12 > 1", "bollinger_z_12 <= 0"),
    "rsi_revert": (S("rsi_revert", {"window": 12, "entry": 45.0, "exit": 52.0}), "cutler_rsi_12 < 45", "cutler_rsi_12 >= 52"),
    "donchian_breakout": (S("donchian_breakout", {"window": 6, "exit_position": 0.4}), "breakout_distance_6 > -0.5", "donchian_position_6 < 0.4"),
    "channel_revert": (S("channel_revert", {"window": 12, "entry": 0.1, "exit": 0.4}), "donchian_position_12 < 0.1", "donchian_position_12 >= 0.4"),
    "momentum_volume": (S("momentum_volume", {"window": 6, "volume_window": 24, "min_volume_ratio": 1.0}), "momentum_6 > 0 AND volume_ratio_24 > 1", "momentum_6 <= 0"),
    "momentum_low_vol": (S("momentum_low_vol", {"window": 6, "vol_window": 12, "max_volatility": 1.5}), "momentum_6 > 0 AND return_volatility_12 < 1.5", "momentum_6 <= 0"),
    "body_followthrough": (S("body_followthrough", {"minimum": 0.1}), "bar_body > 0.1", "bar_body <= 0"),
    "wide_range_breakout": (S("wide_range_breakout", {"range_minimum": 0.5, "location_minimum": 0.1}), "bar_range > 0.5 AND close_location > 0.1", "close_location <= 0"),
}
# The donchian test compares with 0; its factor is shown with another threshold to have entries in these data.
STRATEGIES["donchian_breakout"] = (STRATEGIES["donchian_breakout"][0], "breakout_distance_6 > 0", "donchian_position_6 < 0.4")


def signal_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    s = STRATEGIES[name][0]
    return s.signals(factor_frame(spark, sf_dir, signals.needed_factors([s])))


def signal_cte(name: str) -> str:
    """CTE g: symbol, t, close, entry, exit."""
    s, go, stop = STRATEGIES[name]
    return f"{factors_cte(signals.needed_factors([s]))}, g AS (SELECT symbol, t, close, coalesce({go}, false) AS entry, coalesce({stop}, false) AS exit FROM f)"


def _register_signals(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signal_frame(spark, sf_dir, name).select("symbol", t_ms(), F.col("entry").cast("int").alias("entry"), F.col("exit").cast("int").alias("exit"))

    query(f"{with_sql(signal_cte(name))} SELECT symbol, t AS t_ms, CAST(entry AS INTEGER) AS entry, CAST(exit AS INTEGER) AS exit FROM g", f"signals_{name}")(run)


for _name in STRATEGIES:
    _register_signals(_name)

POSITION_SQL = f"""{signal_cte('momentum_volume')}, z AS (SELECT *, lead(t) OVER m IS NULL AS last FROM g WINDOW m AS (PARTITION BY symbol ORDER BY t)),
v AS (SELECT *, CASE WHEN entry AND NOT last AND NOT (exit OR last) THEN 1 WHEN (exit OR last) AND NOT (entry AND NOT last) THEN 0 END AS ev FROM z),
pos AS (SELECT symbol, t, close, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos FROM v)"""


def equity_sql(pos: str, out: str, keys: str = "symbol") -> str:
    """CTEs that turn a CTE of keys, t, close, pos into its equity curve."""
    return f"""{out}1 AS (SELECT *, coalesce(lag(pos) OVER m, 0) AS pp FROM {pos} WINDOW m AS (PARTITION BY {keys} ORDER BY t)),
{out}2 AS (SELECT *, last_value(CASE WHEN pos = 1 AND pp = 0 THEN 100.0::DOUBLE / close END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS units FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN pos = 1 AND pp = 0 THEN -100.0::DOUBLE * 1.001::DOUBLE * 1.001::DOUBLE WHEN pos = 0 AND pp = 1 THEN units * close * 0.999::DOUBLE * 0.999::DOUBLE ELSE 0 END AS flow FROM {out}2),
{out}4 AS (SELECT *, 10000.0::DOUBLE + sum(flow) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + pos * coalesce(units, 0) * close AS equity FROM {out}3),
{out} AS (SELECT *, equity / coalesce(lag(equity) OVER (PARTITION BY {keys} ORDER BY t), 10000.0::DOUBLE) - 1 AS ret FROM {out}4)"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.positions(signal_frame(spark, sf_dir, "momentum_volume")).select(*GROUPS, "timestamp", "close", "pos")


@query(f"{with_sql(POSITION_SQL)} SELECT symbol, t AS t_ms, CAST(pos AS INTEGER) AS pos FROM pos")
def position_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).select("symbol", t_ms(), "pos")


@query(f"""{with_sql(POSITION_SQL)}, {equity_sql('pos', 'q')}, w AS (SELECT *, last_value(CASE WHEN pos = 1 AND pp = 0 THEN t END IGNORE NULLS) OVER h AS entry_ms, last_value(CASE WHEN pos = 1 AND pp = 0 THEN close END IGNORE NULLS) OVER h AS entry_close FROM q WINDOW h AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, entry_ms, t AS exit_ms, entry_close, close AS exit_close FROM w WHERE pos = 0 AND pp = 1""")
def trade_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.trades(held(spark, sf_dir)).select("symbol", F.unix_millis("entry_at").alias("entry_ms"), F.unix_millis("exit_at").alias("exit_ms"), "entry_close", "exit_close")


@query(f"{with_sql(POSITION_SQL)}, {equity_sql('pos', 'q')} SELECT symbol, t AS t_ms, round(equity, 6) AS equity, round(ret, 9) AS bar_return FROM q")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.equity(held(spark, sf_dir)).select("symbol", t_ms(), F.round("equity", 6).alias("equity"), F.round("bar_return", 9).alias("bar_return"))


BASE_SQL = f"""base AS (SELECT symbol, t, close, CASE WHEN lead(t) OVER (PARTITION BY symbol ORDER BY t) IS NULL THEN 0 ELSE 1 END AS pos FROM pos), {equity_sql('base', 'h')}"""


@query(f"{with_sql(POSITION_SQL)}, {BASE_SQL} SELECT symbol, t AS t_ms, round(equity, 6) AS equity FROM h")
def buy_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.equity(simulate.buy_hold(held(spark, sf_dir))).select("symbol", t_ms(), F.round("equity", 6).alias("equity"))


@query(f"{with_sql(POSITION_SQL)}, {equity_sql('pos', 'q')}, {BASE_SQL} SELECT q.symbol, q.t AS t_ms, round(q.ret - h.ret, 9) AS excess FROM q JOIN h ON q.symbol = h.symbol AND q.t = h.t")
def excess_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.excess_returns(held(spark, sf_dir)).select("symbol", t_ms(), F.round("excess", 9).alias("excess"))


@query(f"""{with_sql(POSITION_SQL)}, {equity_sql('pos', 'q')}, k AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM q)
SELECT symbol, CAST(count(*) AS BIGINT) AS bars, CAST(sum(CAST(pos <> pp AS INTEGER)) AS BIGINT) AS orders, CAST(sum(CAST(pos < pp AS INTEGER)) AS BIGINT) AS closed_trades, round(arg_max(equity, t), 6) AS end_value,
  round(min(equity / peak - 1), 9) AS max_drawdown, round(arg_max(equity, t) / 10000 - 1, 9) AS total_return, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(2190), 6) AS sharpe FROM k GROUP BY symbol""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simulate.performance(simulate.equity(held(spark, sf_dir)))
    return out.select("symbol", "bars", "orders", "closed_trades", F.round("end_value", 6).alias("end_value"), F.round("max_drawdown", 9).alias("max_drawdown"), F.round("total_return", 9).alias("total_return"), F.round("sharpe", 6).alias("sharpe"))


@query(f"""{with_sql(factors_cte([('momentum', 6)]))}, l AS (SELECT symbol, t, close, momentum_6 AS x, unnest([-0.5, 0.0, 0.5, 1.0]::DOUBLE[]) AS threshold FROM f),
v AS (SELECT *, coalesce(last_value(CASE WHEN x > threshold THEN 1 WHEN x <= threshold THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol, threshold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos FROM l),
w AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol, threshold ORDER BY t), 0) AS pp FROM v),
a AS (SELECT symbol, threshold, sum(CASE WHEN pos > pp THEN -ln(close) - ln(1.001::DOUBLE * 1.001::DOUBLE) WHEN pos < pp THEN ln(close) + ln(0.999::DOUBLE * 0.999::DOUBLE) ELSE 0 END) + CASE WHEN arg_max(pos, t) = 1 THEN ln(arg_max(close, t)) ELSE 0 END AS gain,
  CAST(sum(CAST(pos > pp AS INTEGER)) AS BIGINT) AS entries, CAST(sum(CAST(pos < pp AS INTEGER)) AS BIGINT) AS exits FROM w GROUP BY 1, 2)
SELECT symbol, threshold, entries, exits, round(exp(gain) - 1, 6) AS total_return FROM a""")
def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_frame(spark, sf_dir, [("momentum", 6)])
    return simulate.scan_thresholds(rows, "momentum_6", [-0.5, 0.0, 0.5, 1.0]).select("symbol", "threshold", "entries", "exits", F.round("total_return", 6).alias("total_return"))


@query(f"""WITH {bars_sql('4h')}, c AS (SELECT symbol, t, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY t) - 1 AS factor FROM bars),
k AS (SELECT symbol, t, coalesce(lag(factor) OVER (PARTITION BY symbol ORDER BY t) > 0, false) AS target FROM c)
SELECT symbol, t AS t_ms, CAST(target AS INTEGER) AS target, CAST(target AND NOT coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY t), false) AS INTEGER) AS entry FROM k""")
def execution_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign of the return over three bars that a bar completes, as the target at the next bar's close."""
    rows = event_bars(spark, sf_dir, "4h").withColumn("target", signals.execution_target(3))
    return simulate.edges(rows).select("symbol", t_ms(), F.col("target").cast("int").alias("target"), F.col("entry").cast("int").alias("entry"))


# Information coefficients.
IC_FACTORS = ("momentum_6", "ma_gap_12", "bollinger_z_6", "volume_ratio_6")
IC_SPECS = [("momentum", 6), ("ma_gap", 12), ("bollinger_z", 6), ("volume_ratio", 6)]


def rank_sql(rows: str, x: str, y: str, keys: str, least: int, out: str) -> str:
    """CTEs for the rank correlation of x and y in each of the keys."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE"
    return f"""{out}r AS (SELECT *, {rank(x)} AS ra, {rank(y)} AS rb FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{out} AS (SELECT {keys}, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic, count(*) AS n FROM {out}r GROUP BY {keys} HAVING count(*) >= {least} AND stddev_pop(ra) * stddev_pop(rb) > 1e-12)"""


LABEL_SQL = f"{factors_cte(IC_SPECS)}, lb AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY t) / close - 1 AS label, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_no FROM f)"


@query(f"{with_sql(LABEL_SQL)} SELECT symbol, t AS t_ms, round(label, 9) AS label FROM lb")
def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, "4h").withColumn("label", stats.forward_return()).select("symbol", t_ms(), F.round("label", 9).alias("label"))


@query(f"WITH {bars_sql('4h')} SELECT symbol, t AS t_ms, rank() OVER (PARTITION BY t ORDER BY volume) + (count(*) OVER (PARTITION BY t, volume) - 1) / 2.0::DOUBLE AS rank FROM bars")
def ranks_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, "4h").withColumn("rank", stats.average_rank("volume", ["timestamp"])).select("symbol", t_ms(), "rank")


@query(f"{with_sql(LABEL_SQL)}, {rank_sql('lb', 'momentum_6', 'label', 't', 3, 'ic')} SELECT t AS t_ms, round(ic, 9) AS ic, CAST(n AS BIGINT) AS n FROM ic")
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ic_series(factor_frame(spark, sf_dir, [("momentum", 6)]), "momentum_6").select(t_ms(), F.round("ic", 9).alias("ic"), "n")


@query(f"{with_sql(LABEL_SQL)}, {rank_sql('lb', 'momentum_6', 'label', 't', 3, 'ic')} SELECT round(avg(ic), 9) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 9) AS ir, CAST(count(*) AS BIGINT) AS periods FROM ic")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.summarize_ic(stats.ic_series(factor_frame(spark, sf_dir, [("momentum", 6)]), "momentum_6"))
    return out.select(F.round("mean_ic", 9).alias("mean_ic"), F.round("ir", 9).alias("ir"), "periods")


# p-values derived from the events, a family for each hour of the day.
P_SQL = "pv AS (SELECT event_type AS trial, hour(ts) AS family, (min(event_id) * 7919 % 1000 + 1) / 10000.0::DOUBLE AS p FROM events GROUP BY 1, 2)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("trial"), F.hour("ts").alias("family")).agg(F.min("event_id").alias("m"))
    return rows.select("trial", "family", ((F.col("m") * 7919 % 1000 + 1) / 10000.0).alias("p"))


@query(f"WITH {P_SQL} SELECT trial, CAST(family AS INTEGER) AS family, round(least(1, p * count(*) OVER (PARTITION BY family)), 9) AS adjusted FROM pv")
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.adjust_pvalues(p_values(spark, sf_dir), "bonferroni", ["family"]).select("trial", "family", F.round("adjusted", 9).alias("adjusted"))


@query(f"""WITH {P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM pv)
SELECT trial, CAST(family AS INTEGER) AS family, round(least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS adjusted FROM r""")
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.adjust_pvalues(p_values(spark, sf_dir), "fdr_bh", ["family"]).select("trial", "family", F.round("adjusted", 9).alias("adjusted"))


# Walk-forward folds of 60 + 1 + 30 times, as many as the bars allow.
FOLD_SQL = f"""{LABEL_SQL}, nt AS (SELECT count(DISTINCT t) AS n FROM f), fo AS (SELECT k AS fold, k * 30 AS train_start, k * 30 + 60 AS train_end, k * 30 + 61 AS test_start, k * 30 + 91 AS test_end FROM (SELECT unnest(range(0, (SELECT (n - 91) // 30 + 1 FROM nt))) AS k)),
ph AS (SELECT fold, 'train' AS phase, train_start AS lo, train_end AS hi FROM fo UNION ALL SELECT fold, 'test', test_start, test_end FROM fo),
lg AS (SELECT t, bar_no, label, unnest([{', '.join(f"'{x}'" for x in IC_FACTORS)}]) AS factor, unnest([{', '.join(IC_FACTORS)}]) AS value FROM lb),
jj AS (SELECT lg.*, fold, phase FROM lg JOIN ph ON bar_no >= lo AND bar_no + 1 < hi), {rank_sql('jj', 'value', 'label', 'fold, phase, factor, t', 3, 'fi')}"""


def folds_of(frame: DataFrame) -> list[dict[str, int]]:
    return study.time_folds(frame.select("timestamp").distinct().count(), 60, 30, 1)


@query(f"{with_sql(FOLD_SQL)} SELECT CAST(fold AS INTEGER) AS fold, CAST(train_start AS INTEGER) AS train_start, CAST(train_end AS INTEGER) AS train_end, CAST(test_start AS INTEGER) AS test_start, CAST(test_end AS INTEGER) AS test_end FROM fo")
def folds_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_bars(spark, sf_dir, "4h")
    return study.fold_frame(rows, folds_of(rows))


@query(f"{with_sql(FOLD_SQL)} SELECT CAST(fold AS INTEGER) AS fold, phase, factor, round(avg(ic), 9) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 8) AS ir, CAST(count(*) AS BIGINT) AS periods FROM fi GROUP BY fold, phase, factor")
def walk_forward_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_frame(spark, sf_dir, IC_SPECS)
    out = stats.summarize_ic(study.fold_ics(rows, IC_FACTORS, folds_of(rows)), ["fold", "phase", "factor"])
    return out.select("fold", "phase", "factor", F.round("mean_ic", 9).alias("mean_ic"), F.round("ir", 8).alias("ir"), "periods")


# Trials of the training folds: a p-value of each factor derived from its mean, corrected inside the fold.
TRIAL_SQL = f"""{FOLD_SQL}, sm AS (SELECT fold, factor, avg(ic) AS mean_ic, count(*) AS n FROM fi WHERE phase = 'train' GROUP BY 1, 2),
tr AS (SELECT *, round(exp(-4 * abs(mean_ic) * sqrt(n)), 12) AS p, count(*) OVER (PARTITION BY fold) AS m FROM sm)"""


def training_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_frame(spark, sf_dir, IC_SPECS)
    ics = stats.summarize_ic(study.fold_ics(rows, IC_FACTORS, folds_of(rows)).where("phase = 'train'"), ["fold", "factor"])
    return stats.adjust_pvalues(ics.withColumn("p", F.round(F.exp(-4 * F.abs("mean_ic") * F.sqrt("periods")), 12)), "bonferroni", ["fold"])


@query(f"""{with_sql(TRIAL_SQL)}, rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY (least(1, p * m) <= 0.5) DESC, abs(mean_ic) DESC, list_position([{', '.join(f"'{x}'" for x in IC_FACTORS)}], factor)) AS k FROM tr)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN least(1, p * m) <= 0.5 THEN factor END AS selected FROM rk WHERE k = 1""")
def select_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor of largest mean among those whose corrected p reaches the level; none where all miss it."""
    return study.select_factors(training_trials(spark, sf_dir), IC_FACTORS, 0.5)


@query(f"{with_sql(LABEL_SQL)}, ho AS (SELECT lb.* FROM lb, (SELECT count(DISTINCT t) AS n FROM f) WHERE bar_no >= n - greatest(30, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AND bar_no + 1 < n), {rank_sql('ho', 'bollinger_z_6', 'label', 't', 3, 'hi')} SELECT round(avg(ic), 9) AS mean_ic, CAST(count(*) AS BIGINT) AS periods FROM hi")
def holdout_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_frame(spark, sf_dir, IC_SPECS)
    times = rows.select("timestamp").distinct().count()
    sealed = times - study.holdout_times(times, 30, 0.2)
    fold = {"fold": 0, "train_start": 0, "train_end": 0, "test_start": sealed, "test_end": times}
    out = stats.summarize_ic(study.fold_ics(rows, ["bollinger_z_6"], [fold]).where("phase = 'test'"))
    return out.select(F.round("mean_ic", 9).alias("mean_ic"), "periods")


BLOCK_SQL = f"""{FOLD_SQL}, bk AS (SELECT symbol, momentum_6 AS value, label, fold, CAST(floor((bar_no - test_start) / 10.0) AS BIGINT) AS block_no FROM lb JOIN fo ON bar_no >= test_start AND bar_no < test_end WHERE test_start + (CAST(floor((bar_no - test_start) / 10.0) AS BIGINT) + 1) * 10 < test_end),
{rank_sql('bk', 'value', 'label', 'symbol, fold, block_no', 10, 'bi')}"""


@query(f"{with_sql(BLOCK_SQL)} SELECT symbol, 'momentum_6' AS factor, CAST(fold AS INTEGER) AS fold, CAST(block_no AS INTEGER) AS block_no, round(ic, 9) AS ic, CAST(n AS BIGINT) AS n FROM bi")
def factor_ic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_frame(spark, sf_dir, IC_SPECS)
    out = study.factor_ic_blocks(rows, ["momentum_6"], folds_of(rows), 10)
    return out.select("symbol", "factor", "fold", "block_no", F.round("ic", 9).alias("ic"), "n")


def boot_sql(block: int, resamples: int, seed: int, centred: bool) -> str:
    """CTE me: symbol, r, mean, observed, n of block resamples of the bars' returns."""
    return f"""WITH {bars_sql('4h')}, rt AS (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS x FROM bars),
se AS (SELECT symbol, x{' - avg(x) OVER (PARTITION BY symbol)' if centred else ''} AS v, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, avg(x) OVER (PARTITION BY symbol) AS observed FROM rt WHERE x IS NOT NULL),
sh AS (SELECT symbol, any_value(n) AS n, any_value(observed) AS observed FROM se GROUP BY symbol HAVING any_value(n) >= {block}),
dr AS (SELECT symbol, n, observed, r, k, ('0x' || substr(md5('{seed}|' || r || '|' || k), 1, 8))::BIGINT % n AS start, least({block}, n - k * {block}) AS len FROM (SELECT *, unnest(range(0, (n + {block} - 1) // {block})) AS k FROM (SELECT *, unnest(range(0, {resamples})) AS r FROM sh))),
ix AS (SELECT symbol, n, observed, r, (start + j) % n AS i FROM (SELECT *, unnest(range(0, len)) AS j FROM dr)),
me AS (SELECT ix.symbol, ix.r, sum(se.v) / any_value(ix.n) AS mean, any_value(ix.observed) AS observed, any_value(ix.n) AS n FROM ix JOIN se ON se.symbol = ix.symbol AND se.i = ix.i GROUP BY 1, 2)"""


def bar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*GROUPS).orderBy("timestamp")
    return event_bars(spark, sf_dir, "4h").withColumn("x", F.col("close") / F.lag("close").over(w) - 1).select("symbol", "timestamp", "x")


@query(f"{boot_sql(6, 199, 7, True)} SELECT symbol, round((count(*) FILTER (WHERE abs(mean) >= abs(observed) - 1e-15) + 1) / 200.0::DOUBLE, 9) AS p FROM me GROUP BY symbol")
def bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.block_bootstrap(bar_returns(spark, sf_dir), ["symbol"], "x", "timestamp", 6, 199, 7).select("symbol", F.round("p", 9).alias("p"))


@query(f"{boot_sql(6, 199, 11, False)} SELECT symbol, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM me GROUP BY symbol")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.block_interval(bar_returns(spark, sf_dir), ["symbol"], "x", "timestamp", 6, 199, 11)
    return out.select("symbol", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


def two_sided_sql(series: str, keys: str, value: str, order: str, block: int, resamples: int, seed: int, out: str, least: int = 10) -> str:
    """CTE out: keys, p of circular block resamples of a CTE series, without those shorter than max(least, two blocks)."""
    return f"""{out}s AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n, avg({value}) OVER (PARTITION BY {keys}) AS observed FROM {series}),
{out}h AS (SELECT {keys}, any_value(n) AS n, any_value(observed) AS observed FROM {out}s GROUP BY {keys} HAVING any_value(n) >= {max(least, 2 * block)}),
{out}d AS (SELECT *, ('0x' || substr(md5('{seed}|' || r || '|' || k), 1, 8))::BIGINT % n AS start, least({block}, n - k * {block}) AS len FROM (SELECT *, unnest(range(0, (n + {block} - 1) // {block})) AS k FROM (SELECT *, unnest(range(0, {resamples})) AS r FROM {out}h))),
{out}m AS (SELECT {', '.join(f'g.{c}' for c in keys.split(', '))}, g.r, sum(s.x - g.observed) / any_value(g.n) AS mean, any_value(g.observed) AS observed FROM (SELECT *, (start + j) % n AS i FROM (SELECT *, unnest(range(0, len)) AS j FROM {out}d)) g JOIN {out}s s ON {' AND '.join(f's.{c} = g.{c}' for c in keys.split(', '))} AND s.i = g.i GROUP BY ALL),
{out} AS (SELECT {keys}, (count(*) FILTER (WHERE abs(mean) >= abs(observed) - 1e-15) + 1) / {resamples + 1}.0::DOUBLE AS p FROM {out}m GROUP BY {keys})"""


FACTOR_TRIAL_SQL = f"""{FOLD_SQL}, lo AS (SELECT symbol, fold, factor, value, label, CAST(floor((bar_no - test_start) / 6.0) AS BIGINT) AS block_no FROM (SELECT symbol, bar_no, label, unnest([{', '.join(f"'{x}'" for x in IC_FACTORS)}]) AS factor, unnest([{', '.join(IC_FACTORS)}]) AS value FROM lb) JOIN fo ON bar_no >= test_start AND bar_no < test_end WHERE test_start + (CAST(floor((bar_no - test_start) / 6.0) AS BIGINT) + 1) * 6 < test_end),
{rank_sql('lo', 'value', 'label', 'symbol, factor, fold, block_no', 6, 'bi')}, {two_sided_sql('bi', 'factor', 'ic', 'symbol, fold, block_no', 3, 199, 7, 'bp')},
ft AS (SELECT bi.factor, count(*) AS blocks, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, coalesce(any_value(bp.p), 1) AS p FROM bi LEFT JOIN bp ON bp.factor = bi.factor GROUP BY bi.factor)"""


def factor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_frame(spark, sf_dir, IC_SPECS)
    return study.factor_trials(study.factor_ic_blocks(rows, IC_FACTORS, folds_of(rows), 6, least=6), resamples=199, seed=7)


@query(f"{with_sql(FACTOR_TRIAL_SQL)} SELECT factor, CAST(blocks AS BIGINT) AS blocks, round(mean_ic, 9) AS mean_ic, round(ir, 8) AS ir, round(p, 9) AS p, round(least(1, p * count(*) OVER ()), 9) AS adjusted FROM ft")
def factor_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every factor over the rank-correlation blocks of all test folds: mean, ratio, two-sided block p, correction."""
    out = factor_rollup(spark, sf_dir)
    return out.select("factor", "blocks", F.round("mean_ic", 9).alias("mean_ic"), F.round("ir", 8).alias("ir"), F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


@query(f"{with_sql(FACTOR_TRIAL_SQL)}, rk AS (SELECT factor, mean_ic, row_number() OVER (ORDER BY abs(mean_ic) DESC, factor) AS place FROM ft) SELECT factor, round(mean_ic, 9) AS mean_ic, CAST(place AS INTEGER) AS place FROM rk WHERE place <= 15")
def notable_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 factors of largest absolute mean."""
    return study.notable(factor_rollup(spark, sf_dir), F.abs("mean_ic"), "factor", 15).select("factor", F.round("mean_ic", 9).alias("mean_ic"), "place")


@query(f"""{with_sql(LABEL_SQL)}, hn AS (SELECT symbol, t, momentum_6 AS value, bar_no, count(*) OVER (PARTITION BY symbol) AS bars, lead(close, 2) OVER (PARTITION BY symbol ORDER BY t) / lead(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS later FROM lb),
ht AS (SELECT * FROM hn WHERE bar_no >= CAST(floor(bars * 0.8::DOUBLE) AS BIGINT)), {rank_sql('ht', 'value', 'later', 'symbol', 3, 'hs')} SELECT symbol, round(ic, 9) AS ic, CAST(n AS BIGINT) AS n FROM hs""")
def holdout_series_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over the holdout's times of a factor known at a close and the return from the next close to the one after."""
    out = study.holdout_series_ic(factor_frame(spark, sf_dir, IC_SPECS), "momentum_6", 0.2)
    return out.select("symbol", F.round("ic", 9).alias("ic"), "n")


_PLACES = f"[{', '.join(f"'{x}'" for x in IC_FACTORS)}]"
#: Development times, folds inside them, IC of each phase, p and correction of the training phase, the choice, its holdout.
STUDY_SQL = f"""{LABEL_SQL}, nt AS (SELECT n, n - greatest(30, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AS sealed FROM (SELECT count(DISTINCT t) AS n FROM f)),
fo AS (SELECT k AS fold, k * 30 AS train_start, k * 30 + 60 AS train_end, k * 30 + 61 AS test_start, k * 30 + 91 AS test_end FROM (SELECT unnest(range(0, (SELECT (sealed - 91) // 30 + 1 FROM nt))) AS k)),
ph AS (SELECT fold, 'train' AS phase, train_start AS lo, train_end AS hi FROM fo UNION ALL SELECT fold, 'test', test_start, test_end FROM fo UNION ALL SELECT -1, 'holdout', sealed, n FROM nt),
lg AS (SELECT t, bar_no, label, unnest({_PLACES}) AS factor, unnest([{', '.join(IC_FACTORS)}]) AS value FROM lb),
jj AS (SELECT lg.*, fold, phase FROM lg JOIN ph ON bar_no >= lo AND bar_no + 1 < hi), {rank_sql('jj', 'value', 'label', 'fold, phase, factor, t', 3, 'fi')},
tn AS (SELECT * FROM fi WHERE phase = 'train'), {two_sided_sql('tn', 'fold, factor', 'ic', 't', 3, 199, 7, 'wp', 5)},
sm AS (SELECT tn.fold, tn.factor, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, count(*) AS periods, coalesce(any_value(wp.p), 1) AS p FROM tn LEFT JOIN wp ON wp.fold = tn.fold AND wp.factor = tn.factor GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p) AS k, count(*) OVER (PARTITION BY fold) AS m FROM sm),
aj AS (SELECT *, least(1, min(p * m / k) OVER (PARTITION BY fold ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM rk),
ch AS (SELECT *, adjusted <= 0.5 AND row_number() OVER (PARTITION BY fold ORDER BY (adjusted <= 0.5) DESC, abs(mean_ic) DESC, list_position({_PLACES}, factor)) = 1 AS selected FROM aj),
te AS (SELECT fold, factor, avg(ic) AS ic FROM fi WHERE phase = 'test' GROUP BY 1, 2), ho AS (SELECT factor, avg(ic) AS ic FROM fi WHERE phase = 'holdout' GROUP BY 1)"""


@query(f"""{with_sql(STUDY_SQL)} SELECT CAST(ch.fold AS INTEGER) AS fold, ch.factor, round(mean_ic, 9) AS mean_ic, round(ir, 8) AS ir, CAST(periods AS BIGINT) AS periods, round(p, 9) AS p, round(adjusted, 9) AS adjusted, CAST(selected AS INTEGER) AS selected, round(te.ic, 9) AS test_ic,
  CASE WHEN selected AND ch.fold = (SELECT max(fold) FROM fo) THEN round(ho.ic, 9) END AS holdout_ic FROM ch LEFT JOIN te ON te.fold = ch.fold AND te.factor = ch.factor LEFT JOIN ho ON ho.factor = ch.factor""")
def walk_forward_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole factor study: bootstrap, correction, selection, test and holdout."""
    out = study.factor_study(factor_frame(spark, sf_dir, IC_SPECS), IC_FACTORS, 60, 30, alpha=0.5)
    rounded = {c: F.round(c, 8 if c == "ir" else 9) for c in ("mean_ic", "ir", "p", "adjusted", "test_ic", "holdout_ic")}
    return out.withColumns({**rounded, "selected": F.col("selected").cast("int")}).select("fold", "factor", "mean_ic", "ir", "periods", "p", "adjusted", "selected", "test_ic", "holdout_ic")


STUDIED = {k: v[0] for k, v in STRATEGIES.items()}


def _strategy_sql() -> str:
    """CTEs up to xs: strategy, symbol, fold, t, excess, moved of the strategies over the test folds."""
    specs = signals.needed_factors(list(STUDIED.values()))
    flags = ", ".join(f"coalesce({go}, false) AS go_{k}, coalesce({stop}, false) AS stop_{k}" for k, (_, go, stop) in STRATEGIES.items())
    names = ", ".join(f"'{k}'" for k in STRATEGIES)
    gos, stops = (", ".join(f"{x}_{k}" for k in STRATEGIES) for x in ("go", "stop"))
    key = "strategy, symbol, fold"
    return f"""{factors_cte(specs)}, nt AS (SELECT count(DISTINCT t) AS bars FROM f), fo AS (SELECT k AS fold, 61 + 30 * k AS a, least(91 + 30 * k, dev) AS b FROM (SELECT unnest(range(0, 1000)) AS k, (SELECT CAST(floor(bars * 0.8::DOUBLE) AS BIGINT) - 1 FROM nt) AS dev) WHERE least(91 + 30 * k, dev) - (61 + 30 * k) >= 30),
sg AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS bar_no, {flags} FROM f),
lg AS (SELECT symbol, t, close, bar_no, unnest([{names}]) AS strategy, unnest([{gos}]) AS entry, unnest([{stops}]) AS exit FROM sg),
z AS (SELECT lg.*, fold, lead(t) OVER (PARTITION BY {key} ORDER BY t) IS NULL AS last FROM lg JOIN fo ON bar_no >= a AND bar_no < b),
v AS (SELECT *, CASE WHEN entry AND NOT last AND NOT (exit OR last) THEN 1 WHEN (exit OR last) AND NOT (entry AND NOT last) THEN 0 END AS ev FROM z),
pos AS (SELECT strategy, symbol, fold, t, close, last, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos FROM v),
base AS (SELECT strategy, symbol, fold, t, close, CASE WHEN last THEN 0 ELSE 1 END AS pos FROM pos), {equity_sql('pos', 'q', key)}, {equity_sql('base', 'h', key)},
xs AS (SELECT q.strategy, q.symbol, q.fold, q.t, q.ret - h.ret AS excess, CAST(q.pos <> q.pp AS INTEGER) AS moved FROM q JOIN h ON q.strategy = h.strategy AND q.symbol = h.symbol AND q.fold = h.fold AND q.t = h.t),
{two_sided_sql('xs', 'strategy', 'excess', 'symbol, fold, t', 6, 199, 7, 'sp')},
st AS (SELECT xs.strategy, avg(excess) AS mean_excess, count(*) AS bars, sum(moved) AS orders, coalesce(any_value(sp.p), 1) AS p FROM xs LEFT JOIN sp ON sp.strategy = xs.strategy GROUP BY xs.strategy),
sa AS (SELECT *, least(1, p * count(*) OVER ()) AS adjusted FROM st),
se AS (SELECT *, adjusted <= 0.5 AND mean_excess > 0 AS eligible FROM sa),
sr AS (SELECT *, eligible AND row_number() OVER (ORDER BY eligible DESC, mean_excess DESC, strategy) = 1 AS selected FROM se)"""


@query(f"{with_sql(_strategy_sql())} SELECT strategy, round(mean_excess, 9) AS mean_excess, CAST(bars AS BIGINT) AS bars, CAST(orders AS BIGINT) AS orders, round(p, 9) AS p, round(adjusted, 9) AS adjusted, CAST(selected AS INTEGER) AS selected FROM sr")
def strategy_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies over bar folds with costs, two-sided bootstrap p-values, their correction, and the one selected."""
    rows = factor_frame(spark, sf_dir, signals.needed_factors(list(STUDIED.values())))
    bars = rows.select("timestamp").distinct().count()
    folds = study.bar_folds(bars, 60, 30, 1, 0.2)
    out = study.strategy_trials(rows, STUDIED, folds, 6, 199)
    out = study.select_strategy(stats.adjust_pvalues(out.withColumn("family", F.lit("strategies")), "bonferroni", ["family"]), 0.5)
    return out.select("strategy", F.round("mean_excess", 9).alias("mean_excess"), "bars", "orders", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"), F.col("selected").cast("int").alias("selected"))
