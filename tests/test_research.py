import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.scalar import fees, security_code
from quantloom.functions.tails import add_hac_t, benjamini_hochberg, two_sided_p
from quantloom.operators import combine, evaluate, models, moments, performance, portfolio, selection, stored_models

PERIODS = {"development": ("2014-01-01", "2017-12-31"), "validation": ("2018-01-01", "2018-12-31"), "test": ("2019-01-01", "2019-12-31")}


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(4)
    dates = pd.date_range("2014-01-31", periods=48, freq="ME").date
    rows = [(d, f"f{k}", float(rng.normal(0.02 * (k - 1), 0.05))) for d in dates for k in range(4)]
    return spark.createDataFrame(rows, "signal_date date, factor_name string, value double").cache()


@pytest.mark.parametrize("method", [*combine.CLOSED_FORM, *combine.MATRIX])
def test_weights_are_long_only(history, method):
    w = combine.factor_weights(history, method).toPandas()["weight"]
    assert len(w) == 4 and (w >= 0).all() and w.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("method", ["ridge", "lasso"])
def test_learned_weights(history, method):
    w = combine.learned_weights(history, method).toPandas()["weight"]
    assert len(w) == 4 and (w >= 0).all() and w.sum() == pytest.approx(1.0)
    with pytest.raises(ValueError):
        combine.learned_weights(history, method, latest_allowed="2015-01-01")


def test_best_ratio_beats_random_portfolios():
    rng = np.random.default_rng(0)
    x = rng.normal(0.02, 0.1, size=(12, 5))
    cov, mean = combine.shrunk_covariance(x), x.mean(axis=0)
    w = combine.best_ratio(mean, cov)
    w = w / w.sum()
    score = w @ mean / np.sqrt(w @ cov @ w)
    for other in rng.dirichlet(np.ones(5), 3000):
        assert other @ mean / np.sqrt(other @ cov @ other) <= score + 1e-9


def test_robust_t_against_loop(spark):
    rng = np.random.default_rng(1)
    for n in (2, 3, 30, 130):
        x = rng.normal(0.1, 1, n)
        got = add_hac_t(spark.createDataFrame([(x.tolist(),)], "s array<double>"), "s", "t").first()["t"]
        if n < 3:
            assert got is None
            continue
        lags = min(int(4 * (n / 100) ** (2 / 9)), n - 1)
        c = x - x.mean()
        var = sum((1 if k == 0 else 2 * (1 - k / (lags + 1))) * (c[k:] @ c[: n - k]) / n for k in range(lags + 1))
        assert got == pytest.approx(x.mean() / np.sqrt(var / n))


def test_normal_tail(spark):
    import math

    t = [0.0, 0.3, 1.96, 2.8, 3.0, 5.0, 12.0]
    got = spark.createDataFrame([(v,) for v in t], "t double").select(two_sided_p("t").alias("p")).toPandas()["p"]
    np.testing.assert_allclose(got, [math.erfc(v / math.sqrt(2)) for v in t], rtol=1e-9)


def test_step_up_is_monotone(spark):
    rows = [(0.01,), (0.04,), (0.03,), (None,), (0.9,)]
    got = benjamini_hochberg(spark.createDataFrame(rows, "p double"), "p", "q").toPandas().sort_values("p")
    np.testing.assert_allclose(got["q"], [0.04, 0.16 / 3, 0.16 / 3, 0.9, np.nan])


def test_linear_models_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [0.5, -0.1, 0.0] + rng.normal(size=300) * 0.1 + 2
    frame = pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"])
    df = spark.createDataFrame(frame)
    ols = models.fit(df, ["a", "b", "c"], "y", "ols")
    design = np.column_stack([np.ones(300), x])
    expected = np.linalg.lstsq(design, y, rcond=None)[0]
    np.testing.assert_allclose([ols.intercept, *ols.coefficients], expected, rtol=1e-8, atol=1e-10)
    z = (x - x.mean(0)) / x.std(0)
    ridge = models.fit(df, ["a", "b", "c"], "y", "ridge", {"ridge": {"alpha": 7.0}})
    w = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    np.testing.assert_allclose(ridge.coefficients, w, rtol=1e-7)
    lasso = models.fit(df, ["a", "b", "c"], "y", "lasso", {"lasso": {"alpha": 0.05}})
    w = np.array(lasso.coefficients) * x.std(0)
    gradient = z.T @ (y - y.mean() - z @ w) / 300
    for g, v in zip(gradient, w):
        assert abs(g - 0.05 * np.sign(v)) < 1e-8 if v else abs(g) <= 0.05 + 1e-9
    predicted = ols.predict(df).toPandas()["prediction"]
    np.testing.assert_allclose(predicted, design @ expected, rtol=1e-8)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i, d in enumerate(pd.date_range("2015-01-31", periods=60, freq="ME").date):
        for k in range(30):
            a, b = rng.normal(size=2)
            rows.append((d, f"s{k}", float(a), float(b) if k % 7 else None, float(0.3 * a + rng.normal() * 0.1) if i < 59 else None))
    return spark.createDataFrame(rows, "signal_date date, symbol string, A double, B double, forward_return double").cache()


def test_frozen_scores_every_row_and_sees_no_test_row(features):
    scored, meta = models.frozen(features, ["A", "B"], PERIODS, "ols")
    rows = scored.toPandas()
    assert len(rows) == 1800 and rows["prediction"].notna().all()
    assert meta["train_rows"] == 36 * 30
    moved = features.withColumn("forward_return", F.when(F.col("signal_date") > "2017-12-31", F.lit(99.0)).otherwise(F.col("forward_return")))
    again, _ = models.frozen(moved, ["A", "B"], PERIODS, "ols")
    np.testing.assert_allclose(again.orderBy("signal_date", "symbol").toPandas()["prediction"], scored.orderBy("signal_date", "symbol").toPandas()["prediction"])


def test_labels_that_end_later_are_purged(features):
    ends = features.select("signal_date").distinct().withColumn("label_end_date", F.add_months("signal_date", 2))
    _, meta = models.frozen(features, ["A", "B"], PERIODS, "ols", label_ends=ends)
    assert meta["train_rows"] == 34 * 30


def test_walk_forward_refits_on_the_past(features):
    months = sorted(r[0] for r in features.select("signal_date").distinct().collect())
    refits = models.refit_dates(months, dt.date(2014, 1, 1), dt.date(2018, 12, 31))
    assert [months.index(d) for d in refits] == [24, 36]
    assert models.refit_dates(months, dt.date(2016, 6, 1), dt.date(2018, 12, 31)) == [months[30], months[42]]
    frame = features.toPandas()
    for method, settings in (("ols", {}), ("ridge", {"ridge": {"alpha": 3.0}})):
        scored = models.walk_forward(features, ["A", "B"], PERIODS, method, settings=settings).toPandas()
        assert len(scored) == 1800 and scored["prediction"].isna().sum() == 24 * 30
        expected = []
        for i in (24, 36):
            past = frame[frame["signal_date"] < months[i]]
            fill = past[["A", "B"]].median()
            x, y = past[["A", "B"]].fillna(fill).to_numpy(), past["forward_return"].to_numpy()
            mean, scale = x.mean(axis=0), x.std(axis=0)
            z = (x - mean) / scale
            w = np.linalg.solve(z.T @ z + (3.0 if method == "ridge" else 0.0) * np.eye(2), z.T @ (y - y.mean())) / scale
            block = frame[(frame["signal_date"] >= months[i]) & ((frame["signal_date"] < months[36]) | (i == 36))]
            expected.append(block.assign(p=(block[["A", "B"]].fillna(fill).to_numpy() - mean) @ w + y.mean()))
        both = pd.concat(expected).merge(scored, on=["signal_date", "symbol"])
        assert len(both) == 36 * 30
        np.testing.assert_allclose(both["prediction"], both["p"], atol=1e-12)


def test_moments_of_spans_add_up(spark):
    """Large means, gaps, ties and empty spans: equal to each sample read on its own."""
    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(10)]
    edges = [days[3], days[4], days[4], days[9]]
    data = [(days[k % 10], float(1e8 + rng.normal()) if k % 3 else None, float(rng.integers(0, 4)) if k % 10 > 4 else None, float(-1e6 + rng.normal()) if k % 11 else None) for k in range(700)]
    rows = moments.with_span(spark.createDataFrame(data, "signal_date date, a double, b double, y double"), edges).repartition(5)
    found, middles = moments.moments(rows, ["a", "b"], "y", 5), moments.medians(rows, ["a", "b"], 5)
    frame = pd.DataFrame(data, columns=["day", "a", "b", "y"])
    frame["span"] = [sum(e <= d for e in edges) for d in frame["day"]]
    for last in range(5):
        sample = frame[frame["span"] <= last]
        exact = sample[["a", "b"]].median().dropna().to_dict()
        assert middles[last] == pytest.approx(exact, rel=1e-15) and set(middles[last]) == set(exact)
        for products, part in ((found.before(last), sample), (found.between(0, last), sample[sample["span"] > 0])):
            part = part[part["y"].notna()].fillna({"a": 1e8, "b": 1.5})
            z = np.column_stack([np.ones(len(part)), part[["a", "b", "y"]].to_numpy() - found.shift]) if len(part) else np.zeros((0, 4))
            np.testing.assert_allclose(found.filled(products, {"a": 1e8, "b": 1.5}), z.T @ z, rtol=1e-9, atol=1e-6)


def test_tree_models_run(features):
    small = {"rf": {"numTrees": 5, "maxDepth": 3}, "xgb": {"maxIter": 3, "maxDepth": 2}, "dtree": {"maxDepth": 3}}
    for method in small:
        scored, _ = models.frozen(features, ["A", "B"], PERIODS, method, settings=small)
        assert scored.where("prediction IS NULL").count() == 0


def test_trees_do_not_depend_on_the_layout(features):
    small = {"rf": {"numTrees": 6, "maxDepth": 4}, "xgb": {"maxIter": 4, "maxDepth": 2, "subsamplingRate": 0.8}}
    for method in small:
        both = []
        for rows in (features, features.repartition(7, "B").orderBy(F.desc("A"))):
            scored, meta = models.frozen(rows, ["A", "B"], PERIODS, method, settings=small)
            both.append(scored.orderBy("signal_date", "symbol").toPandas()["prediction"].tolist())
            inside = scored.where(F.col("signal_date") <= PERIODS["development"][1]).withColumnRenamed("forward_return", "label")
            errors = models.fit_errors(inside).first()
            assert errors["rows"] == 36 * 30 and errors["model_error"] < 0.8 * errors["constant_error"]
        assert both[0] == both[1]


def test_stored_models(spark, features, tmp_path):
    class Words:
        """Counts of letters, as a model with both interfaces."""

        def predict(self, texts):
            return [len(t) for t in texts]

        def transform(self, texts):
            return [[t.count("a"), t.count("b")] for t in texts]

    folder, end = str(tmp_path), dt.date(2016, 12, 31)
    estimator = stored_models.LinearEstimator(np.array([2.0, -1.0]), 0.5, np.array([0.0, 3.0]))
    stored_models.save(spark, folder, estimator, "m", "1", end, ["A", "B"])
    model = stored_models.load(spark.newSession(), folder, "m", "1")
    assert model.training_end == end and model.columns == ("A", "B")
    later = features.where(F.col("signal_date") > F.lit(end))
    got = stored_models.apply(later, model).toPandas()
    np.testing.assert_allclose(got["prediction"], 2 * got["A"] - got["B"].fillna(3.0) + 0.5)
    assert len(got) == later.count()
    with pytest.raises(Exception, match="trained until 2016-12-31"):
        stored_models.apply(features, model).collect()
    with pytest.raises(ValueError, match="columns"):
        stored_models.apply(later.drop("B"), model)
    with pytest.raises(Exception, match="exists"):
        stored_models.save(spark, folder, estimator, "m", "1", end, ["A", "B"])
    damaged = stored_models.StoredModel(**{**model.__dict__, "payload": b"x"})
    spark.createDataFrame([("bad", "1", end, ["A"], damaged.digest, bytearray(b"x"))], stored_models.ROW).write.parquet(f"{folder}/bad/1")
    with pytest.raises(ValueError, match="damaged"):
        stored_models.load(spark, folder, "bad", "1")
    texts = spark.createDataFrame([(1, "abba"), (2, "")], "k int, text string")
    words = stored_models.save(spark, folder, Words(), "words", "2", end, ["text"])
    assert [(r["k"], r["n"]) for r in stored_models.apply(texts, words, "n", date=None).collect()] == [(1, 4.0), (2, 0.0)]
    assert [r["v"] for r in stored_models.apply(texts, words, "v", date=None, method="transform").collect()] == [[2.0, 2.0], [0.0, 0.0]]


def test_low_correlation_keeps_the_strongest(spark):
    names = ["A", "B", "C"]
    pairs = spark.createDataFrame([("A", "A", 1.0), ("A", "B", 0.9), ("A", "C", 0.1), ("B", "B", 1.0), ("B", "C", 0.2), ("C", "C", 1.0)], "left string, right string, correlation double")
    priority = spark.createDataFrame([("A", 0.02), ("B", -0.05), ("C", 0.01)], "factor_name string, priority double")
    assert selection.low_correlation(pairs, priority, names) == ["B", "C"]


def test_selection_refuses_test_figures(spark):
    factors = spark.createDataFrame([("f", "value")], "factor_id string, family string")
    metrics = spark.createDataFrame([], "factor_id string, metric_name string, period string, orientation string, index_code string, metric_value double")
    with pytest.raises(ValueError):
        selection.resolve(factors, metrics, sort_by={"metric": "rank_ic", "period": "test"}, top_n=1)
    with pytest.raises(ValueError):
        selection.check_isolation(spark.createDataFrame([(dt.date(2019, 1, 1),)], "signal_date date"), "2019-01-01")


def test_keyed_sample_is_repeatable_and_grows(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = {r["k"] for r in selection.keyed_sample(df, 0.1, ["k"]).collect()}
    assert a == {r["k"] for r in selection.keyed_sample(df.repartition(7), 0.1, ["k"]).collect()}
    assert 1800 < len(a) < 2200 and a > {r["k"] for r in selection.keyed_sample(df.where("k < 5000"), 0.1, ["k"]).collect()}
    assert selection.keyed_sample(df, 1.0, ["k"]).count() == 20000


def test_words_keep_their_letters(spark):
    docs = spark.createDataFrame([(1, "Été, straße été"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in models.document_vectors(docs, "text").collect()}
    expected = [0.0] * 64
    for w in ("été", "straße", "été"):
        expected[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    assert got == {1: expected, 2: [0.0] * 64}


def test_pairwise_correlation_against_pandas(spark):
    rng = np.random.default_rng(8)
    rows = [(dt.date(2020, 1, 31) if i < 40 else dt.date(2020, 2, 29), f"s{i:03d}", *[float(v) if rng.random() > 0.1 else None for v in rng.normal(size=3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "signal_date date, symbol string, a double, b double, c double")
    got = evaluate.correlation_by_date(df, ["a", "b", "c"]).toPandas().set_index(["signal_date", "left", "right"])["correlation"]
    for d, g in df.toPandas().groupby("signal_date"):
        expected = g[["a", "b", "c"]].astype(float).rank(pct=True).corr()
        for i, j in (("a", "b"), ("a", "c"), ("b", "c")):
            assert got[(d, i, j)] == pytest.approx(expected.loc[i, j], abs=1e-10)
    spread = evaluate.correlation_by_date(df.repartition(5), ["a", "b", "c"], hot=True).toPandas().set_index(["signal_date", "left", "right"])["correlation"]
    pd.testing.assert_series_equal(spread.sort_index(), got.sort_index())
    plan = evaluate.mean_correlation(evaluate.correlation_by_date(df, ["a", "b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_relative_performance_starts_at_one(spark):
    rows = [(dt.date(2020, m, 28), r, 0.0) for m, r in ((1, -0.1), (2, 0.05), (3, 0.02))]
    df = spark.createDataFrame(rows, "signal_date date, p double, b double").withColumn("k", F.lit(1))
    got = performance.relative_performance(df, ["k"], "p", "b", 12.0).first()
    assert got["max_drawdown"] == pytest.approx(-0.1)
    nav = 0.9 * 1.05 * 1.02
    assert got["annualized_return"] == pytest.approx(nav**4 - 1)
    plain = performance.performance(df, ["k"], "p").first()
    assert plain["max_drawdown"] == pytest.approx(0.0)


def test_replay_finds_short_positions(spark):
    cols = "trade_date date, symbol string, side string, shares double, price double, commission double, stamp_tax double, transfer_fee double, status string"
    rows = [(dt.date(2024, 1, 2), "a", "buy", 100.0, 10.0, 1.0, 0.0, 0.1, "filled"), (dt.date(2024, 1, 3), "a", "sell", 40.0, 11.0, 1.0, 0.5, 0.1, "filled"), (dt.date(2024, 1, 4), "a", "sell", 90.0, 11.0, 0.0, 0.0, 0.0, "rejected")]
    cash, positions, short = portfolio.replay(spark.createDataFrame(rows, cols), 10000.0)
    assert cash.first()["cash"] == pytest.approx(10000 - 1000 - 1.1 + 440 - 1.6)
    assert positions.first()["shares"] == 60 and short.count() == 0
    _, _, short = portfolio.replay(spark.createDataFrame(rows[1:2], cols), 0.0)
    assert short.count() == 1


def test_running_positions_of_one_busy_security(spark):
    """One security has nearly all fills: its history is cut into slices, and the sums go through."""
    rng = np.random.default_rng(8)
    days = pd.date_range("2020-01-01", periods=500).date
    rows = [(days[rng.integers(500)], "busy" if k % 50 else "idle", "buy" if rng.random() < 0.5 else "sell", float(rng.integers(1, 9)), "filled", k % 3) for k in range(4000)]
    frame = pd.DataFrame(rows, columns=["trade_date", "symbol", "side", "shares", "status", "sequence"])
    frame["net"] = frame["shares"].where(frame["side"] == "buy", -frame["shares"])
    for order in (["trade_date"], ["trade_date", "sequence"]):
        trades = spark.createDataFrame(rows, "trade_date date, symbol string, side string, shares double, status string, sequence int")
        got = portfolio.running_positions(trades if len(order) > 1 else trades.drop("sequence")).toPandas().sort_values(["symbol", *order])
        want = frame.groupby(["symbol", *order])["net"].sum().groupby(level=0).cumsum()
        assert got["position"].tolist() == want.tolist()
    short = {r["symbol"]: (r["lowest"], r["places"]) for r in portfolio.short_positions(trades).collect()}
    assert short == {s: (x.min(), len(x)) for s, x in want[want < 0].groupby(level=0)}


def test_fee_schedule_dates(spark):
    rows = [(dt.date(2022, 4, 28), "sell"), (dt.date(2022, 4, 29), "sell"), (dt.date(2023, 8, 28), "sell"), (dt.date(2023, 8, 28), "buy")]
    got = spark.createDataFrame(rows, "d date, side string").select(*[c.alias(n) for n, c in fees("d", "side", F.lit(1e6)).items()]).toPandas()
    assert got["stamp_tax"].tolist() == pytest.approx([1000, 1000, 500, 0])
    assert got["transfer_fee"].tolist() == pytest.approx([20, 10, 10, 10])


def test_codes(spark):
    df = spark.createDataFrame([("sh.600000",), ("600000.SH",), ("000001",), ("830001",)], "c string").select(security_code("c").alias("s"))
    assert [r["s"] for r in df.collect()] == ["600000.SH", "600000.SH", "000001.SZ", "830001.BJ"]
    with pytest.raises(Exception, match="unsupported security code"):
        spark.createDataFrame([("12",)], "c string").select(security_code("c")).collect()


def test_holding_changes(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "period_no int, symbol string, weight double")
    got = {r["period_no"]: (r["buys"], r["sells"]) for r in portfolio.turnover(df, []).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.5, 0.5)}


def test_bars_are_stored_once_for_all_steps_of_a_query(spark, monkeypatch):
    """The parts of a query used to write the bars again, and to read the trades again for the calendar."""
    from quantloom import session
    from quantloom.catalog import load
    from quantloom.operators import portfolio
    from quantloom.sources.market import Market

    written, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: written.append(df.columns) or cut(df))
    m = Market(spark, "/root/testdata/sf0.001")
    kept = m.stored()
    assert m.stored() is kept and kept.stored() is kept
    assert sorted(map(tuple, kept.calendar.collect())) == sorted(map(tuple, m.calendar.collect()))
    assert not kept.month_ends.inputFiles()
    written.clear()
    load()["B6_period_scenario_table"].build(Market(spark, "/root/testdata/sf0.001"))
    assert sum("adj_close" in columns for columns in written) == 1

    reads, made = [], portfolio.cut
    monkeypatch.setattr(portfolio, "cut", lambda df: reads.append(df.columns) or made(df))
    load()["B1_quintile_portfolios"].build(Market(spark, "/root/testdata/sf0.001"))
    assert any("layer" in columns and "symbol" in columns for columns in reads)


def test_ic_matrix_ranks_its_panel_once(spark):
    """The means of the ranks came from a second computation of all ranks, joined back."""
    import datetime

    from quantloom.operators import evaluate

    rows = [(datetime.date(2024, 1, 31), f"s{i}", "a", float(i * 7 % 11) if i % 5 else None, float(i % 4) if i % 6 else None) for i in range(30)]
    panel = spark.createDataFrame(rows, "signal_date date, symbol string, factor_name string, raw_value double, forward_return double")
    got = evaluate.ic_matrix(panel)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first()["rank_ic"] == pytest.approx(evaluate.ic_matrix(panel, hot=True).first()["rank_ic"])


def test_training_layout_follows_from_the_rows_not_from_the_session(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_PART", 100)
    rng = np.random.default_rng(8)
    train = spark.createDataFrame(
        [(dt.date(2014, 1, 1) + dt.timedelta(days=i // 20), f"S{i % 20}", *map(float, rng.normal(size=3))) for i in range(450)],
        "signal_date date, symbol string, a double, b double, y double")
    layouts = []
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for setting in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", setting)
        try:
            dealt = models.settled(train, ["a", "b"], "y")
            assert dealt.rdd.getNumPartitions() == 5
            rows = dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
            layouts.append(sorted(map(tuple, rows.collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert layouts[0] == layouts[1] and len(layouts[0]) == 450


def test_a_run_of_models_prepares_its_sample_once(spark, monkeypatch):
    from quantloom.plans import research

    rng = np.random.default_rng(9)
    rows = [(d, f"S{k}", *map(float, rng.normal(size=3))) for d in pd.date_range("2014-01-31", periods=24, freq="ME").date for k in range(6)]
    features = spark.createDataFrame(rows, "signal_date date, symbol string, A double, B double, forward_return double")
    alone = [models.frozen(features, ["A", "B"], PERIODS, k)[0].collect() for k in ("ols", "ridge")]
    calls = []
    whole, middle = moments.moments, moments.medians
    monkeypatch.setattr(moments, "moments", lambda *a, **k: calls.append("moments") or whole(*a, **k))
    monkeypatch.setattr(moments, "medians", lambda *a, **k: calls.append("medians") or middle(*a, **k))
    panel = research.model_run(features, ["A", "B"], PERIODS, ["ols", "ridge"])
    assert sorted(calls) == ["medians", "moments"]
    for name, scored in zip(("ols", "ridge"), alone):
        got = {(r.signal_date, r.symbol): r.raw_value for r in panel.where(F.col("factor_name") == name).collect()}
        assert got == pytest.approx({(r.signal_date, r.symbol): r.prediction for r in scored})


def test_summaries_read_stored_monthly_rows(spark):
    rng = np.random.default_rng(10)
    rows = [(d, f"S{k}", "f", *map(float, rng.normal(size=2))) for d in pd.date_range("2017-01-31", periods=30, freq="ME").date for k in range(8)]
    panel = spark.createDataFrame(rows, "signal_date date, symbol string, factor_name string, raw_value double, forward_return double")
    monthly, summary = evaluate.evaluate_batch(panel, PERIODS, value_types=["raw"])
    assert monthly.count() == 60 and summary.count() > 4
    for df in (monthly, summary):
        assert "forward_return" not in df._jdf.queryExecution().optimizedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {f.rsplit("/", 1)[-1] for f in files if "/shuffle_" in f}


@pytest.mark.parametrize("write", ["cut", "stored"])
def test_a_stored_frame_leaves_no_shuffle_files(spark, write):
    """They stayed until the driver collected its garbage, so a query kept the shuffles of all its parts."""
    from quantloom import session

    before = shuffle_files(spark)
    df = spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    kept = getattr(session, write)(df)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_stored_bars_are_not_shuffled_again(spark):
    """Windows over bars and the joins of a panel shuffled by security and date what lay by security."""
    import re

    from quantloom import session
    from quantloom.catalog import evaluation
    from quantloom.functions.rolling import lag
    from quantloom.sources.market import Market

    m = Market(spark, "/root/testdata/sf0.001")
    kept = m.stored()
    assert kept.bars.columns == m.bars.columns
    keys = ["symbol", "trade_date"]
    assert list(map(tuple, kept.bars.orderBy(*keys).collect())) == list(map(tuple, m.bars.orderBy(*keys).collect()))
    window = kept.bars.withColumn("x", lag("adj_close"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in window and "Sort" not in window
    with session.settings(spark, session.IN_PLACE):
        plan = evaluation._panel_rows(m.stored(), evaluation.NAMES, True)._jdf.queryExecution().executedPlan().toString()
    shuffled = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert shuffled and not [keys for keys in shuffled if "symbol" in keys and "date" in keys]
