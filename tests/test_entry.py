"""The driver's contract, with and without the training-data folder."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as engine

ROOT = Path(__file__).resolve().parent.parent
SOME = ("bars_4h", "quality_metrics", "align_forward_close", "factor_ema_gap", "factor_volume_return_correlation", "equity_curve", "ic_series", "bootstrap_p", "risk_gate_reasons")


def test_every_oracle_has_a_query():
    assert set(engine.oracle_sql()) <= set(engine.queries())


def test_entry(spark):
    assert engine.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    a = engine.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    b = con.sql(engine.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    keys = [c for c in columns if c in ("symbol", "t_ms", "o_orderkey")] or columns
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (a, b))
    for c in columns:
        x, y = a[c], b[c]
        if x.dtype == object:
            assert (x.fillna("") == y.fillna("")).all(), c
        else:
            assert ((x.astype(float) - y.astype(float)).abs().fillna(0) < 1e-7).all() and (x.isna() == y.isna()).all(), c


def test_imports_without_training_data(tmp_path):
    (tmp_path / "quantloom").mkdir()
    for name in ("schemas.py", "__init__.py", "operators", "sources", "functions", "plans", "streaming"):
        (tmp_path / "quantloom" / name).symlink_to(ROOT / "quantloom" / name)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q; e.oracle_sql(); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


@pytest.mark.parametrize("name", ("align_leave_null", "align_partial_window", "align_forward_close"))
def test_alignment_of_bars_with_a_price_of_nought(spark, tmp_path, name):
    """Cleaning rejects such bars; the queries hand alignment what is left, as their SQL does."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.001/events.parquet')")
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS value) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = engine.queries()[name](spark, str(tmp_path)).toPandas()
    want = con.sql(engine.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(["symbol", "t_ms"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and got.close.isna().any()
    for c in columns:
        assert (got[c].isna() == want[c].isna()).all() and (got[c].fillna("") == want[c].fillna("")).all(), c


def same_as_sql(spark, con, name, events, folder):
    """The query on a table events made by SQL equals its own SQL there, infinities and nulls too."""
    con.sql(f"COPY ({events}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    got = [tuple(r) for r in engine.queries()[name](spark, str(folder)).collect()]
    want = con.sql(engine.oracle_sql()[name]).fetchall()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    assert len(got) == len(want)
    for a, b in zip(order(got), order(want), strict=True):
        assert [pytest.approx(y, rel=1e-6, abs=1e-7, nan_ok=True) if isinstance(y, float) else y for y in b] == list(a)
    return want


@pytest.mark.parametrize("name", ("adjust_prices", "align_forward_close", "align_leave_null", "bars_1h", "bucketed_merge", "clean_bars", "clean_bars_last_observed", "clean_dedup_last", "duplicate_keys", "keyed_merge", "store_merge", "eligibility_calendar"))
def test_events_of_an_hours_last_half_millisecond(spark, tmp_path, name):
    """epoch_ms takes the nearest millisecond, which is the next hour's first."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    late = "date_trunc('hour', ts) + to_microseconds(3600000000 - 1 - CAST(event_id // 40 AS BIGINT))"
    source = f"SELECT * REPLACE (CASE WHEN event_id % 40 = 7 THEN {late} ELSE ts END AS ts) FROM '/root/testdata/sf0.01/events.parquet'"
    assert con.sql(f"SELECT count(*) FROM ({source}) WHERE epoch_ms(ts) // 3600000 <> epoch_us(ts) // 3600000000").fetchall() == [(250,)]
    assert same_as_sql(spark, con, name, source, tmp_path)


@pytest.mark.parametrize("name", ("factor_parkinson_volatility", "factor_pullback_distance", "factor_catalog_means"))
def test_factors_of_bars_with_a_low_of_nought(spark, tmp_path, name):
    """The queries take bars as they are; what a low of 0 makes infinite is infinite in their SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    source = "SELECT * REPLACE (CASE WHEN event_id IN (2002, 5005) THEN 0 ELSE value END AS value) FROM '/root/testdata/sf0.01/events.parquet'"
    want = same_as_sql(spark, con, name, source, tmp_path)
    assert any(x == float("inf") for row in want for x in row[1:])
