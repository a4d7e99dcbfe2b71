"""Running values over segments, as-of joins and recursive means against plain loops."""

import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.rolling import with_ewm
from quantloom.functions.scans import asof_join, running_sums, span_of, with_recursive_means

START = datetime(2025, 1, 1, tzinfo=UTC)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def test_running_sums(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.choice([None, 1, 2, 5])) for k in range(500)]
    got = running_sums(spark.createDataFrame(rows, "key string, n long, x long"), ["key"], {"part": span_of("n", 37)}, ["n"], {"total": F.col("x"), "row": F.lit(1)}).collect()
    sums, counts = {}, {}
    want = {}
    for key, n, x in rows:
        sums[key], counts[key] = sums.get(key, 0) + (x or 0), counts.get(key, 0) + 1
        want[n] = (sums[key], counts[key])
    assert {r.n: (r.total, r.row) for r in got} == want and len(got) == 500
    assert running_sums(spark.createDataFrame([], "key string, n long"), ["key"], {"p": span_of("n", 3)}, ["n"], {"row": F.lit(1)}).count() == 0


def test_asof_join(spark):
    rnd = random.Random(2)
    left = [(k, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(0, 4000, 7)])) for k in range(300)] + [(1000, "a", 700)] * 3
    right = [(rnd.choice(["a", "a", "b", None, "d"]), rnd.choice([None, *range(1000, 4000, 50)]), k, rnd.random()) for k in range(200)]
    ldf = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, key string, t timestamp")
    rdf = spark.createDataFrame([(k, at(t), n, x) for k, t, n, x in right], "key string, t timestamp, n long, x double")
    for width in (10_000_000, 500_000_000, 10**12):
        out = asof_join(ldf, rdf, ["key"], "t", "t", width, ["n"])
        got = sorted(((r.id, r.found and r.found.n, r.found_first and r.found_first.n) for r in out.collect()), key=str)
        want = []
        for i, key, t in left:
            mine = sorted((u, n) for k, u, n, _ in right if k == key and u is not None and key is not None)
            past = [n for u, n in mine if t is not None and u <= t]
            want.append((i, past[-1] if past else None, mine[0][1] if mine and t is not None else None))
        assert got == sorted(want, key=str)
    assert asof_join(ldf, rdf.where("false"), ["key"], "t", "t", 10**6).where("found is not null").count() == 0
    plan = asof_join(ldf, rdf, ["key"], "t", "t", 10**6)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_key_is_dealt_out_by_time(spark):
    """A third of all rows of one key lie in many partitions, and each row stays one."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("key"), F.timestamp_seconds("id").alias("t"), "id")
    out = asof_join(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "seen"), ["key"], "t", "t", 100_000_000, ["seen"])
    assert out.count() == 30_000
    hot = out.where("key = 'hot'")
    assert hot.where("found.seen <> id - id % 150").count() == 0


def closes(n, seed, nulls=False):
    rnd = random.Random(seed)
    return [None if nulls and rnd.random() < 0.2 else 100 * rnd.random() + 1 for _ in range(n)]


@pytest.mark.parametrize("width", (3_600_000_000, 40 * 3_600_000_000, 10**15))
def test_recursive_means_equal_a_loop(spark, width):
    spans = (1, 2, 6, 120)
    series = {"a": closes(700, 1), "b": closes(300, 2, True), "c": [None, None, 5.0], "d": [None]}
    rows = [(key, at(3600 * k), x) for key, values in series.items() for k, x in enumerate(values)]
    got = with_recursive_means(spark.createDataFrame(rows, "key string, t timestamp, x double"), "x", spans, ["key"], "t", width).collect()
    found = {(r.key, int((r.t.timestamp() - START.timestamp()) / 3600) if r.t.tzinfo else int((r.t - rows[0][1].replace(tzinfo=None)).total_seconds() / 3600)): r for r in got}
    for key, values in series.items():
        for s in spans:
            mean, n = None, 0
            for k, x in enumerate(values):
                if x is not None:
                    n, mean = n + 1, x if mean is None else mean + 2 / (s + 1) * (x - mean)
                r = found[key, k][f"ewm_{s}"]
                assert (r is None) == (x is None or n < s), (key, k, s)
                assert r is None or r == pytest.approx(mean, rel=1e-12)


def test_one_market_runs_in_several_tasks(spark):
    """A long series: equal to pandas, in as many groups as it has spans of time, without a grouped Python function."""
    n = 200_000
    frame = spark.range(n).select(F.lit("x").alias("exchange"), F.lit("a").alias("symbol"), F.lit("1m").alias("timeframe"), F.timestamp_seconds(F.col("id") * 60 + 1_735_689_600).alias("timestamp"), (F.sin(F.col("id") / 50.0) * 10 + 50).alias("close"))
    out = with_ewm(frame, "close", (12, 60))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "_span" in plan
    got = out.select("timestamp", "ewm_12", "ewm_60").toPandas().sort_values("timestamp")
    close = frame.select("timestamp", "close").toPandas().sort_values("timestamp")["close"]
    for s in (12, 60):
        want = close.ewm(span=s, adjust=False, min_periods=s).mean()
        assert (got[f"ewm_{s}"].isna().to_numpy() == want.isna().to_numpy()).all()
        assert pd.Series(got[f"ewm_{s}"].to_numpy() - want.to_numpy()).abs().max() < 1e-10


def test_large_sides_are_dealt_once(spark):
    """Without broadcasts the rows go through one exchange: windows and the join that carries values in share it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.lit("a").alias("key"), F.timestamp_seconds("id").alias("t"), "id")
        sums = running_sums(rows, ["key"], {"s": span_of("id", 100)}, ["id"], {"n": F.lit(1)})
        means = with_recursive_means(rows, "id", (6,), ["key"], "t", 100_000_000)
        met = asof_join(rows, rows.withColumnRenamed("id", "r"), ["key"], "t", "t", 100_000_000, ["r"])
        for frame, column, last in ((sums, "n", 1000), (means, "ewm_6", None), (met, "found.r", 999)):
            assert frame.count() == 1000 and (last is None or frame.agg(F.max(column)).first()[0] == last)
            plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            big = plan[plan.index("SortMergeJoin") :]
            left = big[: big.index("\n", big.index("Exchange"))]
            assert left.count("Exchange") == 1 and "Window" in left, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
