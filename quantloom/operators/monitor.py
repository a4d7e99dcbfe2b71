"""Counters, gauges and histograms of executions: one aggregation whose parts can be merged, for batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# States of an order's life, labels of a denial, upper bounds of the histograms' buckets.
STATUSES = (
    "INITIALIZED", "DENIED", "EMULATED", "RELEASED", "SUBMITTED", "ACCEPTED", "REJECTED", "CANCELED", "EXPIRED", "TRIGGERED",
    "PENDING_UPDATE", "PENDING_CANCEL", "PARTIALLY_FILLED", "FILLED", "VOIDED",
)
DENIALS = ("stale_market", "spread", "price_jump", "position", "portfolio", "other")
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
SCHEMA = "metric string, label string, le double, value double"


def _finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


#: What makes an event of a kind countable; other events are rejected and count as such.
VALID = {
    "order": lambda: F.col("status").isin(*STATUSES) & (F.col("order_id") != ""),
    "denial": lambda: F.lit(True),
    "fill": lambda: (F.col("fee") >= 0) & (F.col("latency_ms") >= 0) & _finite("slippage_bps") & _finite("latency_ms"),
    "portfolio": lambda: (F.col("equity") > 0) & (F.col("drawdown") >= 0) & (F.col("drawdown") <= 1),
}


def judged(events: DataFrame) -> DataFrame:
    """events (kind, time, seq, order_id, status, reason, fee, slippage_bps, latency_ms, equity, drawdown) with valid; unknown
    kinds and unknown values are not."""
    ok = F.lit(False)
    for kind, rule in VALID.items():
        ok = F.when(F.col("kind") == kind, F.coalesce(rule(), F.lit(False))).otherwise(ok)
    return events.withColumn("valid", ok)


def bucket_counts(x: str, where: Column, bounds: Sequence[float] = BOUNDS) -> list[Column]:
    """How many values lie at or under each bound: cumulative, so that counts of parts add up."""
    return [F.count_if(where & (F.col(x) <= F.lit(float(b)))).alias(f"{x}_{k}") for k, b in enumerate(bounds)]


def _of(kind: str) -> Column:
    return (F.col("kind") == kind) & F.col("valid")


def summaries(bounds: Sequence[float] = BOUNDS) -> list[Column]:
    """Aggregates of judged() events that need no keys: fills, fees, gauges, histograms, rejected."""
    last = F.struct("time", "seq")
    out = [F.count_if(_of("fill")).alias("fills"), F.sum(F.when(_of("fill"), F.col("fee"))).alias("fees"), F.count_if(~F.col("valid")).alias("rejected")]
    out += [F.max_by(F.when(_of("portfolio"), F.col(c)), F.when(_of("portfolio"), last)).alias(c) for c in ("equity", "drawdown")]
    for x in ("slippage_bps", "latency_ms"):
        out += [F.sum(F.when(_of("fill"), F.col(x))).alias(f"{x}_sum"), *bucket_counts(x, _of("fill"), bounds)]
    return out


def observed(events: DataFrame, name: str, bounds: Sequence[float] = BOUNDS) -> tuple[DataFrame, Observation]:
    """judged() events whose summaries are taken while something else reads them; of a batch, as observation.get."""
    seen = Observation(name)
    return judged(events).observe(seen, *summaries(bounds)), seen


def observed_stream(events: DataFrame, name: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """The same of a stream: each micro-batch's progress has its summaries as observedMetrics[name], which as_rows() and
    merged() add up."""
    return judged(events).observe(name, *summaries(bounds))


def as_rows(found: dict, bounds: Sequence[float] = BOUNDS) -> list[tuple]:
    """Rows of SCHEMA of one set of summaries."""
    out = [("fills_total", "", None, float(found["fills"])), ("fees_total", "", None, float(found["fees"] or 0)), ("rejected_total", "", None, float(found["rejected"]))]
    out += [(c, "", None, float(found[c])) for c in ("equity", "drawdown") if found[c] is not None]
    for x in ("slippage_bps", "latency_ms"):
        out += [(f"{x}_sum", "", None, float(found[f"{x}_sum"] or 0)), *((f"{x}_bucket", "", float(b), float(found[f"{x}_{k}"])) for k, b in enumerate(bounds))]
    return out


def metrics(events: DataFrame, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """metric, label, le, value: counters by status and by denial, fills, fees, the gauges' last values by time and seq,
    cumulative histograms and the number of rejected events. One aggregation by status and reason with map-side combining, and
    one of its few rows."""
    told = F.when(F.col("reason").isin(*DENIALS), F.col("reason")).otherwise("other")
    label = F.when(_of("order"), F.col("status")).when(_of("denial"), told).otherwise("")
    metric = F.when(_of("order"), "order_events_total").when(_of("denial"), "risk_denials_total").otherwise("rest")
    last = F.struct("time", "seq")
    per = judged(events).groupBy(metric.alias("metric"), label.alias("label")).agg(
        F.count("*").alias("n"), F.max(F.when(_of("portfolio"), last)).alias("gauged"), *summaries(bounds)
    )
    counters = per.where("metric <> 'rest'").select("metric", "label", F.lit(None).cast("double").alias("le"), F.col("n").cast("double").alias("value"))
    one = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("fills", "fees", "rejected", "slippage_bps_sum", "latency_ms_sum")]
    one += [F.max_by(c, "gauged").alias(c) for c in ("equity", "drawdown")]
    one += [F.coalesce(F.sum(f"{x}_{k}"), F.lit(0)).cast("double").alias(f"{x}_{k}") for x in ("slippage_bps", "latency_ms") for k in range(len(bounds))]
    row = lambda metric, le, value: F.struct(F.lit(metric).alias("metric"), F.lit("").alias("label"), F.lit(le).cast("double").alias("le"), F.col(value).alias("value"))
    rows = [row(f"{c}_total", None, c) for c in ("fills", "fees", "rejected")] + [row(c, None, c) for c in ("equity", "drawdown", "slippage_bps_sum", "latency_ms_sum")]
    rows += [row(f"{x}_bucket", float(b), f"{x}_{k}") for x in ("slippage_bps", "latency_ms") for k, b in enumerate(bounds)]
    rest = per.agg(*one).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("value is not null")
    return counters.unionByName(rest)


def merged(parts: DataFrame) -> DataFrame:
    """Metrics of several parts (SCHEMA and part, in order) as those of the whole: counts and sums add up, of a gauge the last
    part's value stands."""
    gauge = F.col("metric").isin("equity", "drawdown")
    value = F.when(F.first(gauge), F.max_by("value", "part")).otherwise(F.sum("value"))
    return parts.groupBy("metric", "label", "le").agg(value.alias("value"))
