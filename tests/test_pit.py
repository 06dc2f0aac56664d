import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import asof, fundamentals, pit
from quantloom.streaming import replay

D = dt.date


def test_adjustments_attach_backward(spark):
    daily = spark.createDataFrame([(D(2024, 1, d), "a", 10.0, 10.0, 10.0, 10.0) for d in (3, 4, 5)] + [(D(2024, 1, 3), "b", 5.0, 5.0, 5.0, 5.0)], "trade_date date, symbol string, open double, high double, low double, close double")
    events = spark.createDataFrame([(D(2023, 12, 1), "a", 2.0), (D(2024, 1, 5), "a", 2.2)], "trade_date date, symbol string, adjust_factor double")
    got = asof.adjust(daily, events).orderBy("symbol", "trade_date").collect()
    assert [r["adjust_factor"] for r in got] == [2.0, 2.0, 2.2, 1.0]
    assert got[2]["adj_close"] == pytest.approx(22.0)


def test_weekly_signals_need_whole_weeks(spark):
    days = [(D(2024, 1, d), d != 5) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15, 16)]
    cal = spark.createDataFrame(days, "trade_date date, is_open boolean")
    got = [r["signal_date"] for r in asof.signal_dates(cal, "weekly").orderBy("signal_date").collect()]
    assert got == [D(2024, 1, 4), D(2024, 1, 12)]
    cut = cal.where(F.col("trade_date") <= F.lit(D(2024, 1, 12)))
    assert [r["signal_date"] for r in asof.signal_dates(cut, "weekly").orderBy("signal_date").collect()] == got
    assert asof.signal_dates(cal, "monthly").count() == 0
    plan = asof.holding_plan(asof.signal_dates(cal, "weekly"), cal).orderBy("signal_date").collect()
    assert [r["entry_date"] for r in plan] == [D(2024, 1, 8), D(2024, 1, 15)]
    assert [r["exit_date"] for r in plan] == [D(2024, 1, 15), None]


def test_next_month_needs_cover(spark):
    cal = spark.createDataFrame([(D(2024, 1, 31), True), (D(2024, 2, 28), True), (D(2024, 3, 29), True)], "trade_date date, is_open boolean")
    got = {r["signal_date"]: r["next_signal_date"] for r in asof.next_month_signal(asof.month_ends(cal), cal).collect()}
    assert got == {D(2024, 1, 31): D(2024, 2, 28), D(2024, 2, 28): None, D(2024, 3, 29): None}


def test_listed_sessions_and_universe(spark):
    cal = spark.createDataFrame([(D(2024, 1, d), True) for d in range(1, 11)], "trade_date date, is_open boolean")
    securities = spark.createDataFrame([("a", D(2023, 5, 1), None), ("b", D(2024, 1, 4), None), ("c", D(2024, 2, 1), None)], "symbol string, list_date date, delist_date date")
    rows = spark.createDataFrame([("a", D(2024, 1, 10)), ("b", D(2024, 1, 6)), ("c", D(2024, 1, 10))], "symbol string, signal_date date")
    got = {r["symbol"]: r["listed_sessions"] for r in asof.listed_sessions(rows, securities, cal).collect()}
    assert got == {"a": 10, "b": 3, "c": 0}


def test_interval_join(spark):
    spans = spark.createDataFrame([("a", "I1", D(2020, 1, 1), D(2020, 12, 31)), ("a", "I2", D(2021, 1, 1), None)], "symbol string, industry_code string, valid_from date, valid_to date")
    rows = spark.createDataFrame([("a", D(2020, 6, 1)), ("a", D(2022, 1, 1)), ("a", D(2019, 1, 1))], "symbol string, signal_date date")
    got = {r["signal_date"]: r["industry_code"] for r in asof.attach_interval(rows, spans, ["industry_code"]).collect()}
    assert got == {D(2020, 6, 1): "I1", D(2022, 1, 1): "I2", D(2019, 1, 1): None}


def test_binned_intervals_are_not_broadcast(spark):
    """A few intervals fill many months: what stands in the bins is no small table."""
    spans = spark.range(50).select(F.concat(F.lit("s"), "id").alias("symbol"), F.col("id").alias("k"), F.lit(D(1990, 1, 1)).alias("valid_from"), F.lit(D(2009, 12, 31)).alias("valid_to"))
    rows = spark.range(50).select(F.concat(F.lit("s"), "id").alias("symbol"), F.lit(D(2001, 5, 1)).alias("signal_date"))
    for found in (asof.attach_interval(rows, spans, ["k"]), asof.covering(rows, spans, ["symbol"])):
        assert sorted((r["symbol"], r["k"]) for r in found.collect()) == sorted((f"s{k}", k) for k in range(50))
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_covering_intervals_equal_brute_force(spark):
    rng = random.Random(3)
    day = lambda: D(2019, 1, 1) + dt.timedelta(days=rng.randrange(900))
    spans = [(rng.choice("ab"), k, day(), None if rng.random() < 0.2 else day()) for k in range(60)]
    points = sorted({(rng.choice("abc"), day()) for _ in range(80)})
    left = spark.createDataFrame(points, "symbol string, signal_date date")
    right = spark.createDataFrame(spans, "symbol string, k int, valid_from date, valid_to date")
    holds = lambda d, s: s[2] <= d and (s[3] is None or s[3] >= d)
    got = sorted((r["symbol"], r["signal_date"], r["k"]) for r in asof.covering(left, right, ["symbol"]).collect())
    assert got == sorted((p[0], p[1], s[1]) for p in points for s in spans if s[0] == p[0] and holds(p[1], s))
    days = sorted({p[1] for p in points})
    got = sorted((r["k"], r["signal_date"]) for r in asof.active_on_dates(right, left, ["k"]).collect())
    assert got == sorted((s[1], d) for d in days for s in spans if holds(d, s))
    plan = asof.active_on_dates(right, left, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "__bin" in plan
    assert asof.covering(left.limit(0), right, ["symbol"]).count() == 0


def test_latest_rows_on_dates(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2024, 3, 5), None), ("b", D(2024, 2, 29), 3.0)], "symbol string, trade_date date, x double")
    dates = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 2, 29),), (D(2024, 3, 5),), (D(2024, 6, 1),)], "signal_date date")
    got = sorted(((r["symbol"], r["signal_date"], r["x"]) for r in pit.latest_on_dates(rows, dates, ["x"]).collect()), key=str)
    assert got == [("a", D(2024, 2, 29), 1.0), ("a", D(2024, 3, 5), None), ("a", D(2024, 6, 1), None), ("b", D(2024, 2, 29), 3.0), ("b", D(2024, 3, 5), 3.0), ("b", D(2024, 6, 1), 3.0)]


def test_marks_go_stale(spark):
    cal = spark.createDataFrame([(D(2024, 1, d), True) for d in range(1, 8)], "trade_date date, is_open boolean")
    bars = spark.createDataFrame([("a", D(2024, 1, 1), 5.0), ("a", D(2024, 1, 7), 6.0), ("b", D(2024, 1, 3), 2.0)], "symbol string, trade_date date, adj_open double")
    grid = asof.carry_marks(bars, cal, sessions=2).orderBy("symbol", "trade_date").toPandas()
    assert grid["mark"].tolist() == [5, 5, 5, 0, 0, 0, 6, 0, 0, 2, 2, 2, 0, 0]
    some = asof.marks_on_dates(bars, cal.select("trade_date"), cal, sessions=2).orderBy("symbol", "trade_date").toPandas()
    assert some["mark"].tolist() == grid["mark"].tolist()


def filings(spark):
    rows = [
        ("a", D(2022, 6, 30), D(2022, 8, 1), 40.0, 1.0),
        ("a", D(2023, 6, 30), D(2023, 8, 1), 60.0, 1.1),
        ("a", D(2022, 12, 31), D(2023, 9, 1), 140.0, 1.2),
        ("a", D(2023, 6, 30), D(2023, 10, 1), 50.0, 1.3),
    ]
    df = spark.createDataFrame(rows, "symbol string, stat_date date, available_date date, revenue double, bps double")
    return df.withColumns({c: F.lit(None).cast("double") for c in ("ocfps", "net_profit", "roe", "gross_margin")})


def test_late_filing_and_revision(spark):
    got = fundamentals.financial_events(filings(spark)).orderBy("available_date").toPandas()
    np.testing.assert_allclose(got["revenue_ttm"], [np.nan, np.nan, 160.0, 150.0])
    assert got["bps"].tolist() == [1.0, 1.1, 1.1, 1.3]
    early = fundamentals.financial_events(filings(spark).where("available_date <= '2023-09-01'")).orderBy("available_date").toPandas()
    np.testing.assert_allclose(early["revenue_ttm"], got["revenue_ttm"][:3])


def replayed(rows, fields):
    """Figures after every release day from all filings known by then."""
    out = {}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[2])
        state = {}
        for k, r in enumerate(mine):
            state[str(r[1])] = dict(zip(fields, r[3:]))
            if k + 1 == len(mine) or mine[k + 1][2] != r[2]:
                out[s, r[2]] = replay.outcome(state)
    return out


def random_filings(rnd, symbol, periods, revisions, holes):
    """Quarters with late filings, revisions and withdrawn values."""
    used = set()
    for _ in range(revisions):
        q = rnd.randrange(periods)
        end = D(2000 + q // 4, 3 * (q % 4) + 3, (31, 30, 30, 31)[q % 4])
        released = end + dt.timedelta(days=rnd.choice([20, 45, 60, 100, 400, 1500]) + rnd.randrange(15))
        if (end, released) not in used:
            used.add((end, released))
            yield (symbol, end, released, *(None if rnd.random() < holes else float(rnd.randrange(1, 90)) for _ in replay.FIELDS))


def compare_with_replay(spark, rows):
    schema = "symbol string, stat_date date, available_date date, " + ", ".join(f"{f} double" for f in replay.FIELDS)
    got = fundamentals.financial_events(spark.createDataFrame(rows, schema)).collect()
    want = replayed(rows, replay.FIELDS)
    assert {(r["symbol"], r["available_date"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        for name, value in want[r["symbol"], r["available_date"]].items():
            assert (np.nan if r[name] is None else r[name]) == pytest.approx(value, nan_ok=True, abs=1e-9), (r, name)


@pytest.mark.parametrize("holes", [0.0, 0.2, 0.8])
def test_states_equal_full_replay(spark, holes):
    rnd = random.Random(4)
    compare_with_replay(spark, [r for k in range(8) for r in random_filings(rnd, f"s{k}", 30, rnd.choice([1, 5, 80]), holes)])


def test_company_with_many_revisions(spark):
    rows = list(random_filings(random.Random(6), "busy", 1200, 10_000, 0.0))
    schema = "symbol string, stat_date date, available_date date, " + ", ".join(f"{f} double" for f in replay.FIELDS)
    frame = spark.createDataFrame([(s, D(1900, 1, 1) + (e - D(2000, 1, 1)), D(1900, 1, 1) + (a - D(2000, 1, 1)), *v) for s, e, a, *v in rows], schema)
    sizes = fundamentals.states(frame, replay.FIELDS, 8).agg(F.max(F.size("state")).alias("most"), F.count("state").alias("days")).first()
    assert sizes["days"] > 5000 and sizes["most"] < 60


def test_stream_outcome_matches_batch(spark):
    state, out = {}, []
    for r in sorted(filings(spark).collect(), key=lambda r: r["available_date"]):
        state[str(r["stat_date"])] = {f: r[f] for f in replay.FIELDS}
        out.append(replay.outcome(state)["revenue_ttm"])
    np.testing.assert_allclose(out, [np.nan, np.nan, 160.0, 150.0])


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_does_not_depend_on_the_order_of_files(spark, tmp_path, seed):
    rows = filings(spark).collect()
    schema = filings(spark).schema
    random.Random(seed).shuffle(rows)
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    job = replay.replay(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = replay.newest(spark.read.parquet(str(tmp_path / "out"))).orderBy("available_date").toPandas()
    np.testing.assert_allclose(got["revenue_ttm"].astype(float), [np.nan, np.nan, 160.0, 150.0])
    assert got["bps"].tolist() == [1.0, 1.1, 1.1, 1.3]


def test_disclosure_rules(spark):
    good = filings(spark)
    fundamentals.require_disclosures(good)
    with pytest.raises(ValueError, match="released_before"):
        fundamentals.require_disclosures(good.withColumn("available_date", F.lit(D(2020, 1, 1))))
    with pytest.raises(ValueError, match="conflicting"):
        fundamentals.require_disclosures(good.unionByName(good.withColumn("bps", F.col("bps") + 1)))


def test_revisions_are_deduplicated_as_of(spark):
    seen = pit.disclosures_on(filings(spark), "2023-09-15").collect()
    assert len(seen) == 3 and {r["revenue"] for r in seen} == {40.0, 60.0, 140.0}


def test_disclosure_operators_read_the_periods_once(spark):
    """Repeated reads, worst inside lambdas, made the work grow with the square of the periods."""
    operators = [fundamentals.ttm("roe"), fundamentals.yoy("roe"), fundamentals.qoq("roe")]
    operators += [fundamentals.stability("roe", 8, 6, growth=g).column for g in (False, True)]
    assert [str(c._jc.toString()).count("state") for c in operators] == [1] * len(operators)
    empty = spark.createDataFrame([("a", D(2020, 3, 31), D(2020, 5, 1), None)], "symbol string, stat_date date, available_date date, roe double")
    named = {"x": fundamentals.stability("roe", 8, 6), "y": fundamentals.stability("roe", 9, 7, growth=True), "z": operators[0], "w": operators[1], "q": operators[2]}
    row = fundamentals.events(empty, named, ["roe"]).first()
    assert all(row[c] is None for c in named)
