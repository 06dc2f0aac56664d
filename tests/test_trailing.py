import numpy as np
import pandas as pd
import pytest

from quantloom.functions.trailing import Wanted, add_last

ROWS = [("A", i, v) for i, v in enumerate([1.0, None, 4.0, 4.0, 4.0, None, 2.0, 0.1, 0.1, 0.1])] + [("B", 0, None), ("B", 1, 3.0)]


def trailing(spark, wanted, at=None):
    df = spark.createDataFrame(ROWS, "symbol string, trade_date int, v double").selectExpr("*", "trade_date % 3 = 0 as asked")
    got = add_last(df, list(wanted.asked.values()), keep=["symbol", "trade_date"], at=at)
    return got.toPandas().sort_values(["symbol", "trade_date"], ignore_index=True)


def test_statistics_of_the_last_rows(spark):
    wanted = Wanted()
    for kind in ("count", "mean", "spread", "highest"):
        wanted.last(kind, "v", 3, 2)
    wanted.last("back", "v", 2)
    got = trailing(spark, wanted)
    v = pd.DataFrame(ROWS, columns=["symbol", "trade_date", "v"]).groupby("symbol")["v"]
    for kind, expected in {
        "mean": v.transform(lambda x: x.rolling(3, min_periods=2).mean()),
        "highest": v.transform(lambda x: x.rolling(3, min_periods=2).max()),
        "spread": v.transform(lambda x: x.rolling(3, min_periods=2).std()),
    }.items():
        np.testing.assert_allclose(got[f"__last_{kind}_v_3_2"], expected, atol=1e-12)
    assert got["__last_spread_v_3_2"][9] == 0.0  # equal values: exactly none
    np.testing.assert_array_equal(got["__last_back_v_2_1"], v.shift(2))


def test_window_functions_give_the_same(spark):
    wanted = Wanted()
    for kind in ("count", "mean", "spread", "highest"):
        wanted.last(kind, "v", 3, 2)
    for before in (0, 2):
        wanted.last("back", "v", before)
    df = spark.createDataFrame(ROWS, "symbol string, trade_date int, v double")
    over = df.withColumns({n: one.column() for n, one in wanted.asked.items()}).drop("v").toPandas().sort_values(["symbol", "trade_date"], ignore_index=True)
    pd.testing.assert_frame_equal(over.astype({n: float for n in wanted.asked}), trailing(spark, wanted))


def test_only_the_rows_asked_for_are_computed(spark):
    wanted = Wanted()
    wanted.last("mean", "v", 3, 2)
    every, some = trailing(spark, wanted), trailing(spark, wanted, "asked")
    expected = every[every.trade_date % 3 == 0].reset_index(drop=True)
    pd.testing.assert_frame_equal(some, expected)


def test_observed_rows_alone_fill_the_frame_and_others_repeat_it(spark):
    wanted = Wanted()
    wanted.last("mean", "v", 3, 2, "v")
    got = trailing(spark, wanted)["__last_mean_v_3_2_v"]
    assert got.iloc[:7].tolist() == pytest.approx([np.nan, np.nan, 2.5, 3.0, 4.0, 4.0, 10 / 3], nan_ok=True)
    assert got.iloc[10:].isna().all()


def test_factors_at_signal_dates_have_no_window_per_row(spark):
    """Long frames were computed for every row; now the pass reads which rows are asked for."""
    from quantloom.operators import library
    from quantloom.sources.market import Market

    m = Market(spark, "/root/testdata/sf0.001")
    plan = library.wide(m.bars, None, ["VOLATILITY_120D", "IDIO_VOL_60D"], m.month_ends)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert "stddev_samp" not in plan and "-119" not in plan
    every = library.wide(m.bars, None, ["VOLATILITY_120D"], m.month_ends, traded=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in every


def test_word_counts_are_computed_once(spark):
    """A filter on the exploded array repeated the whole expression beneath it."""
    from quantloom.catalog import load

    df = load()["A26_embedding"].run(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
