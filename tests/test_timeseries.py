import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.ewm import Deviation, Quotient, Rolling, Step, add_averages
from quantloom.operators import asof, formula, library, technical


def bars_frame(days=160, symbols=3):
    dates = pd.bdate_range("2022-12-01", periods=days).date
    rows = []
    for k in range(symbols):
        for d, when in enumerate(dates):
            close = 10 + k + d * (0.005 + k / 10000) + np.sin(d / 3 + k) * 0.04 * (k + 1)
            rows.append((when, f"s{k}", close - 0.01, close + 0.1, close - 0.1, close, 1000.0 + d * (k + 1), 1e6 + d))
    return pd.DataFrame(rows, columns=["trade_date", "symbol", "open", "high", "low", "close", "volume", "amount"])


@pytest.fixture(scope="module")
def bars(spark):
    df = spark.createDataFrame(bars_frame())
    none = spark.createDataFrame([], "trade_date date, symbol string, adjust_factor double")
    return asof.adjust(df.withColumns({"turnover": F.col("volume") / 1e4, "float_market_cap": F.lit(1e10)}), none)


def test_observations_skip_nulls(spark):
    values = [1.0, None, 2.0, 4.0, None, 8.0, 16.0]
    start = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", start + dt.timedelta(i), v) for i, v in enumerate(values)], "symbol string, trade_date date, x double")
    mean = formula.rolling_mean(df, "x", 3, "m", minimum=2).orderBy("trade_date").toPandas()["m"]
    expected = [None, None, 1.5, 7 / 3, 7 / 3, 14 / 3, 28 / 3]
    np.testing.assert_allclose(mean, [np.nan if v is None else v for v in expected])
    ret = formula.returns(df, "x", 1, "r", skip=1).orderBy("trade_date").toPandas()["r"]
    np.testing.assert_allclose(ret, [np.nan, np.nan, np.nan, 1.0, 1.0, 1.0, 1.0])


def test_averages_leave_other_columns_alone(spark):
    """Histories stay Arrow tables: a long beside a null is not sent through a double."""
    start = dt.date(2024, 1, 1)
    rows = [(e, start + dt.timedelta(i), float(i), None if i == 1 else 2**53 + i) for e in (None, "a", "b") for i in (2, 0, 3, 1)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, x double, k long")
    got = add_averages(df, [Step("e", "x", 1, span=3), Step("f", "e", 1, span=3, minus="x")])
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r["symbol"] or "", r["trade_date"], r["x"], r["k"]) for r in got.collect()), key=str) == sorted(((e or "", d, x, k) for e, d, x, k in rows), key=str)
    assert [(r["e"], r["f"]) for r in got.where("symbol = 'a'").orderBy("trade_date").collect()] == [(0.0, 0.0), (0.5, -0.25), (1.25, -0.5), (2.125, -0.6875)]


def test_averages_decay_over_gaps(spark):
    values = [np.nan, 1.0, 2.0, np.nan, 4.0, 3.0]
    start = dt.date(2024, 1, 1)
    rows = [("a", start + dt.timedelta(i), None if np.isnan(v) else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, x double")
    got = add_averages(df, [Step("e", "x", 2, span=3), Deviation("d", "x", 3, 2)]).orderBy("trade_date").toPandas()
    weight, average, expected, seen = 0.0, np.nan, [], 0
    for v in values:
        if np.isnan(average):
            average, weight = v, 1.0
        else:
            weight *= 0.5
            if not np.isnan(v):
                average = (weight * average + 0.5 * v) / (weight + 0.5)
                weight = 1.0
        seen += not np.isnan(v)
        expected.append(average if seen >= 2 else np.nan)
    np.testing.assert_allclose(got["e"], expected)
    np.testing.assert_allclose(got["d"], [np.nan, np.nan, 0.5, 0.5, 1.0, 0.5])


def test_windows_over_averages_are_steps(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(i), v, i % 2 == 1) for i, v in enumerate([2.0, 0.0, None, 4.0, 8.0, 4.0])]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, x double, asked boolean")
    steps = [Quotient("q", "x", "x", back=1, less=1.0), Rolling("m", "x", 3, 2), Rolling("s", "q", 3, 2, total=True)]
    got = add_averages(df, steps).orderBy("trade_date").toPandas()
    np.testing.assert_allclose(got["q"], [np.nan, -1.0, np.nan, np.nan, 1.0, -0.5])
    np.testing.assert_allclose(got["m"], [np.nan, 1.0, 1.0, 2.0, 6.0, 16 / 3])
    np.testing.assert_allclose(got["s"], [np.nan, np.nan, np.nan, np.nan, np.nan, 0.5])
    some = add_averages(df, steps, at="asked").orderBy("trade_date").toPandas()
    pd.testing.assert_frame_equal(some, got[got["asked"]].reset_index(drop=True))


def test_all_indicators_need_one_shuffle(bars):
    """Windows over averages shuffled every bar a second time, with all early columns in it."""
    plan = technical.indicators(bars.localCheckpoint().repartition(2), technical.ALL_NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning(symbol") == 1


def test_technical_factors_at_signal_dates_equal_those_of_all_bars(bars):
    names = ["TRIX_SIGNAL_12_9", "MASS_MA_9_25_6", "DMI_ADXR_14_6", "ASIT_26_10", "MACD_HIST_12_26_9_PCT"]
    signals = bars.select(F.col("trade_date").alias("signal_date")).distinct().orderBy("signal_date").limit(150).where(F.day("signal_date") > 25)
    some = library.wide(bars, None, names, signals).orderBy("trade_date", "symbol").toPandas()
    every = technical.indicators(bars, names).join(signals, F.col("trade_date") == F.col("signal_date"), "left_semi").orderBy("trade_date", "symbol").toPandas()
    pd.testing.assert_frame_equal(some, every[some.columns])
    assert len(some) > 20 and some.iloc[-1].notna().all()


def test_registry_is_complete():
    assert len(technical.ALL_NAMES) == 98
    assert len(library.REGISTRY) == 169
    assert len(library.BASE_PANEL) == 23 and len(library.SHORT_PANEL) == 41 and len(library.MARKET_SET) == 13


def test_blocked_and_unknown_names():
    with pytest.raises(ValueError):
        technical.resolve("xsii_td1_bfq")
    with pytest.raises(KeyError):
        technical.resolve("NO_SUCH")
    assert technical.resolve("mtm_bfq") == "ROC_12D"


def test_technical_against_pandas(bars):
    names = ["BIAS_20D", "RSI_6D", "KDJ_K_9D", "CCI_14D", "MACD_HIST_12_26_9_PCT", "UP_STREAK", "DAYS_SINCE_HIGH_20D", "OBV"]
    got = technical.indicators(bars, names).where("symbol = 's1'").orderBy("trade_date").toPandas()
    f = bars_frame().query("symbol == 's1'").reset_index(drop=True)
    c, h, low = f["close"], f["high"], f["low"]
    np.testing.assert_allclose(got["BIAS_20D"], c / c.rolling(20, min_periods=16).mean() - 1)
    delta = c.diff()
    gain = delta.clip(lower=0).ewm(span=6, adjust=False, min_periods=6).mean()
    loss = (-delta).clip(lower=0).ewm(span=6, adjust=False, min_periods=6).mean()
    np.testing.assert_allclose(got["RSI_6D"], 100 * gain / (gain + loss))
    dn, up = low.rolling(9, min_periods=7).min(), h.rolling(9, min_periods=7).max()
    k = (100 * (c - dn) / (up - dn)).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean()
    np.testing.assert_allclose(got["KDJ_K_9D"], k)
    tp = (h + low + c) / 3
    mad = tp.rolling(14, min_periods=11).apply(lambda v: np.mean(np.abs(v - v.mean())), raw=True)
    np.testing.assert_allclose(got["CCI_14D"], (tp - tp.rolling(14, min_periods=11).mean()) / (0.015 * mad))
    dif = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    dea = dif.ewm(span=9, adjust=False, min_periods=9).mean()
    np.testing.assert_allclose(got["MACD_HIST_12_26_9_PCT"], 2 * (dif - dea) / c, atol=1e-12)
    run, runs = 0, []
    for d in delta:
        run = run + 1 if d > 0 else 0
        runs.append(run)
    assert got["UP_STREAK"].tolist() == runs
    days = h.rolling(20, min_periods=16).apply(lambda v: len(v) - 1 - np.argmax(v), raw=True)
    np.testing.assert_allclose(got["DAYS_SINCE_HIGH_20D"], days)
    np.testing.assert_allclose(got["OBV"], (np.sign(delta).fillna(0) * f["volume"]).cumsum())


def test_future_rows_change_nothing(bars):
    names = ["MOMENTUM_60D", "VOLATILITY_20D", "AMIHUD_20D", "IDIO_VOL_60D", "RSI_12D"]
    at = bars.select("trade_date").distinct().orderBy("trade_date").limit(120).agg(F.max("trade_date")).first()[0]
    full = library.wide(bars, None, names).where(F.col("trade_date") == at).orderBy("symbol").toPandas()
    cut = library.wide(bars.where(F.col("trade_date") <= at), None, names).where(F.col("trade_date") == at).orderBy("symbol").toPandas()
    pd.testing.assert_frame_equal(full, cut)
    assert full["IDIO_VOL_60D"].notna().all()


def test_residuals_against_least_squares(bars):
    got = formula.idio(formula.market_mean_return(bars, "adj_close"), "adj_close", 60, vol="v", skew="k").toPandas()
    f = bars_frame()
    f["r"] = f.groupby("symbol")["close"].pct_change()
    f["m"] = f.groupby("trade_date")["r"].transform("mean")
    s = f[f["symbol"] == "s2"].dropna().tail(60)
    design = np.column_stack([np.ones(60), s["m"]])
    e = pd.Series(s["r"].to_numpy() - design @ np.linalg.lstsq(design, s["r"].to_numpy(), rcond=None)[0])
    last = got[got["symbol"] == "s2"].sort_values("trade_date").iloc[-1]
    assert last["v"] == pytest.approx(e.std(ddof=1), rel=1e-9)
    assert last["k"] == pytest.approx(e.skew(), rel=1e-6)
