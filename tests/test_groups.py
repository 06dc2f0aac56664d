import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.tails import benjamini_hochberg
from quantloom.operators import combine, cross_section, evaluate


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 900
    # one group holds more than a third of the rows, one value a third of that group
    key = np.where(np.arange(n) < 400, "hot", rng.choice(["a", "b", "c"], n))
    x = np.round(rng.normal(size=n), 2)
    x[:130] = 0.25
    frame = pd.DataFrame({"key": key, "symbol": [f"s{i:04d}" for i in range(n)], "x": x})
    frame.loc[::17, "x"] = np.nan
    return frame


def to_spark(spark, frame):
    rows = frame.astype(object).where(frame.notna(), None)
    return spark.createDataFrame(rows, "key string, symbol string, x double")


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_match_brute_force(spark, table, hot, descending):
    df = groups.ranks(to_spark(spark, table), ["key"], "x", ["symbol"], first="first", average="mean", count="n", descending=descending, hot=hot, slices=7)
    got = df.toPandas().set_index("symbol").sort_index()
    ordered = table.sort_values("symbol").set_index("symbol")
    by = ordered.groupby("key")["x"]
    pd.testing.assert_series_equal(got["first"].astype(float), by.rank(method="first", ascending=not descending), check_names=False)
    pd.testing.assert_series_equal(got["mean"].astype(float), by.rank(ascending=not descending), check_names=False)
    assert (got["n"].to_numpy() == by.transform("count").to_numpy()).all()


@pytest.mark.parametrize("hot", [False, True])
def test_median_and_stats(spark, table, hot):
    df = groups.median(to_spark(spark, table), ["key"], "x", "m", hot=hot)
    df = groups.stats(df, ["key"], {"avg": F.avg("x")}, hot=hot)
    got = df.toPandas().set_index("symbol").sort_index()
    by = table.sort_values("symbol").set_index("symbol").groupby("key")["x"]
    np.testing.assert_allclose(got["m"], by.transform("median"))
    np.testing.assert_allclose(got["avg"], by.transform("mean"))
    assert len(got) == len(table)


def test_hot_check(spark, table):
    df = to_spark(spark, table)
    assert groups.is_hot(df, ["key"], limit=300)
    assert not groups.is_hot(df, ["key"], limit=1000)
    assert not groups.is_hot(df, ["key"], bound=10, limit=300)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 24, 25, 26, 101])
def test_quintile_equals_quantile_cut(spark, n):
    rows = [(float(i), n) for i in range(1, n + 1)]
    got = spark.createDataFrame(rows, "r double, n int").select("r", groups.quintile("r", "n").alias("q")).toPandas().sort_values("r")
    expected = 5 - pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False)
    assert got["q"].tolist() == expected.tolist()


def panel_frame():
    rng = np.random.default_rng(5)
    rows = []
    for d in pd.date_range("2020-01-31", periods=4, freq="ME").date:
        for i in range(60):
            cap = float(np.exp(rng.normal(10, 1)))
            rows.append((d, f"s{i:03d}", "f", float(rng.normal() + 0.1 * np.log(cap)), f"I{i % 4}", cap, float(rng.normal()) if i % 9 else None))
    return rows


PANEL = "signal_date date, symbol string, factor_name string, raw_value double, industry_code string, float_market_cap double, forward_return double"


@pytest.mark.parametrize("hot", [False, True])
def test_neutralised_values_are_orthogonal(spark, hot):
    df = spark.createDataFrame(panel_frame(), PANEL)
    got = cross_section.neutralize(df, ["signal_date", "factor_name"], hot=hot).toPandas()
    assert got["neutralized_value"].notna().all()
    for _, g in got.groupby("signal_date"):
        w = g["float_market_cap"] / g["float_market_cap"].sum()
        r = g["neutralized_value"]
        assert abs((w * r).sum()) < 1e-9
        assert abs((w * r * np.log(g["float_market_cap"])).sum()) < 1e-9
        for _, inside in g.groupby("industry_code"):
            assert abs((inside["float_market_cap"] * inside["neutralized_value"]).sum() / g["float_market_cap"].sum()) < 1e-9
        assert abs((w * r * r).sum() - 1) < 1e-9


def test_hot_evaluation_equals_window_evaluation(spark):
    df = spark.createDataFrame(panel_frame(), PANEL).withColumn("neutralized_value", F.lit(None).cast("double"))
    a = evaluate.monthly_statistics(df, value_types=("raw",)).toPandas()
    b = evaluate.monthly_statistics(df, value_types=("raw",), hot=True).toPandas()
    order = ["signal_date", "orientation"]
    pd.testing.assert_frame_equal(a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True))


def test_monthly_statistics_against_numpy(spark):
    df = spark.createDataFrame(panel_frame(), PANEL)
    got = evaluate.monthly_statistics(df, value_types=("raw",)).where("orientation = 'original'").toPandas().set_index("signal_date")
    frame = pd.DataFrame(panel_frame(), columns=[c.split()[0] for c in PANEL.split(", ")])
    for d, g in frame.groupby("signal_date"):
        s = g.dropna(subset=["raw_value", "forward_return"])
        x, y = s["raw_value"].rank(), s["forward_return"].rank()
        assert got.loc[d, "rank_ic"] == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert got.loc[d, "factor_return"] == pytest.approx(np.polyfit(x, s["forward_return"], 1)[0])
        assert got.loc[d, "coverage"] == pytest.approx(len(s) / len(g))
        q = 5 - pd.qcut(s["raw_value"].rank(method="first"), 5, labels=False)
        for k, v in s.groupby(q)["forward_return"].mean().items():
            assert got.loc[d, f"group_{k}"] == pytest.approx(v)


def test_layers_match_industry_weights(spark):
    rows = [("A" if i < 3 else "B", f"s{i}", float(i), 0.05 + 0.01 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "industry_code string, symbol string, factor_value double, benchmark_weight double").withColumn("signal_date", F.lit("2020-01-31").cast("date"))
    layers = cross_section.check_layers(cross_section.industry_layers(df)).toPandas()
    share = sum(r[3] for r in rows if r[0] == "A") / sum(r[3] for r in rows)
    for _, g in layers.groupby("layer"):
        assert g["target_weight"].sum() == pytest.approx(1.0)
        assert g.loc[g["industry_code"] == "A", "target_weight"].sum() == pytest.approx(share)
    top = layers[(layers["layer"] == 1) & (layers["industry_code"] == "A")]
    assert top["symbol"].tolist() == ["s2"]


def test_hot_layers_equal(spark):
    df = spark.createDataFrame(panel_frame(), PANEL).withColumns({"factor_value": F.col("raw_value"), "benchmark_weight": F.col("float_market_cap")})
    order = ["signal_date", "symbol", "layer"]
    a = cross_section.industry_layers(df).toPandas().sort_values(order).reset_index(drop=True)
    b = cross_section.industry_layers(df, hot=True).toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("hot", [False, True])
def test_reverse_place_equals_a_descending_rank(spark, hot):
    rng = np.random.default_rng(3)
    rows = [(int(k % 3), f"s{k:03d}", None if rng.random() < 0.1 else float(rng.integers(0, 6))) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, symbol string, v double")
    up = groups.ranks(df, ["g"], "v", ["symbol"], first="up", reverse="down", hot=hot, **({"slices": 5} if hot else {}))
    other = groups.ranks(df, ["g"], "v", ["symbol"], first="expected", descending=True).select("symbol", "expected")
    got = up.join(other, "symbol").collect()
    assert len(got) == 200 and all(r["down"] == r["expected"] for r in got)


@pytest.mark.parametrize("family", [[], ["key"]])
def test_q_values_of_a_huge_family(spark, table, family, monkeypatch):
    frame = table.assign(x=table["x"].abs() / 4)
    df = to_spark(spark, frame)
    want = benjamini_hochberg(df, "x", "q", family).toPandas().set_index("symbol").sort_index()
    monkeypatch.setattr(groups, "ROWS_PER_TASK", 37)
    got = benjamini_hochberg(df, "x", "q", family, ties=["symbol"], hot=True).toPandas().set_index("symbol").sort_index()
    pd.testing.assert_frame_equal(got[["x", "q"]], want[["x", "q"]])


def test_weights_of_a_huge_group(spark, table):
    df = to_spark(spark, table)
    want, got = (combine.normalise_nonnegative(df, ["key"], "x", hot).toPandas().set_index("symbol").sort_index() for hot in (False, True))
    pd.testing.assert_series_equal(got["x"], want["x"])
    assert want.groupby("key")["x"].sum().round(9).eq(1).all()
