"""Audits D, set and incremental operators U, streams ST, custom operators UF and end-to-end runs E."""

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import functions as F

from quantloom.catalog.evaluation import COST, COST_ROWS, CTES, LAYER, LONG, MEMBER_CTES, MONTHLY, NAMES, PANEL, PKC, SUMMARY, VARIANT, member_sql, panel, x
from quantloom.catalog.panels import FE, REPLAY
from quantloom.catalog.portfolios import ONE, QUINT, kept_names, schedule_sql
from quantloom.catalog.registry import query
from quantloom.catalog.sources import bundle, event_log
from quantloom.operators import asof, evaluate, fundamentals, incremental, library, models, performance, pit, portfolio, quality, stored_models
from quantloom.plans import panels, research
from quantloom.session import cut, scratch_folder, stored
from quantloom.sources import changelog, tables
from quantloom.sources.market import INDEX_CODE, PERIODS
from quantloom.streaming import replay, sync

# --- audits --------------------------------------------------------------------------------


def shaken(m):
    """Canonical tables where some derived bars, factors and intervals break their rules."""
    t = bundle(m)
    t["daily"] = m.trades.select("symbol", "trade_date", F.col("price").alias("close"), (F.col("price") * (1 + F.col("l_discount") - 0.05)).alias("open"), (F.col("price") * (1 + F.col("l_tax") / 2)).alias("high"),
                                 F.col("price").alias("low"), F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") - 1000).alias("amount"))
    t["adjustments"] = m.adjustments.withColumn("adjust_factor", F.col("adjust_factor") - 1.02)
    t["industries"] = m.industries.withColumn("valid_to", F.when(F.col("industry_code") == "I1", F.lit("1999-02-01").cast("date")).otherwise(F.col("valid_to")))
    return t


query("D1_audit", lambda m: quality.audit(shaken(m), index_code=INDEX_CODE, formal=True, metadata={"industry_snapshot_only": True}).where("severity <> 'info' AND bad_rows > 0"), "table rule severity", "bad_rows", ints="bad_rows",
      ctes="trades adjustments industries", extra={
          "sh": "SELECT symbol, trade_date, price AS c, price * (1 + l_discount - 0.05) AS o, price * (1 + l_tax / 2) AS h, price AS l, l_extendedprice - 1000 AS a FROM trades",
          "si": "SELECT symbol, valid_from, CASE WHEN industry_code = 'I1' THEN DATE '1999-02-01' ELSE valid_to END AS valid_to FROM industries",
          "so": "SELECT *, lead(valid_from) OVER (PARTITION BY symbol ORDER BY valid_from) AS nx FROM si",
          "res": """SELECT 'daily' AS "table", 'invalid_ohlc' AS rule, count(*) AS bad_rows FROM sh WHERE h < greatest(o, c, l) OR l > least(o, c, h)
            UNION ALL SELECT 'daily', 'negative_volume_or_amount', count(*) FROM sh WHERE a < 0
            UNION ALL SELECT 'daily', 'duplicate_key', count(*) FROM (SELECT symbol, trade_date FROM sh GROUP BY ALL HAVING count(*) > 1)
            UNION ALL SELECT 'adjustments', 'factor_not_positive', count(*) FROM adjustments WHERE adjust_factor - 1.02 <= 0
            UNION ALL SELECT 'industries', 'overlapping_intervals', count(*) FROM so WHERE nx IS NOT NULL AND (valid_to IS NULL OR nx <= valid_to)
            UNION ALL SELECT 'industries', 'end_before_start', count(*) FROM si WHERE valid_to < valid_from
            UNION ALL SELECT 'industries', 'snapshot_only', 1"""},
      sql="""SELECT "table", rule, 'error' AS severity, bad_rows FROM res WHERE bad_rows > 0""")


def sessions_as_intervals(m):
    return m.table("events").select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("valid_from"), F.date_add("ts", F.floor(F.col("value") / 100).cast("int") - 1).alias("valid_to"))


query("D2_interval_audit", lambda m: quality.audit_intervals(sessions_as_intervals(m).groupBy("symbol", "valid_from").agg(F.max("valid_to").alias("valid_to")), "events"), "table rule", "bad_rows", ints="bad_rows",
      extra={"iv": "SELECT user_id AS s, ts::DATE AS a, max((ts::DATE + floor(value / 100)::INT - 1)::DATE) AS b FROM events GROUP BY ALL", "io": "SELECT *, lead(a) OVER (PARTITION BY s ORDER BY a) AS nx FROM iv"},
      sql="""SELECT 'events' AS "table", 'end_before_start' AS rule, count(*) FILTER (b < a) AS bad_rows FROM io UNION ALL SELECT 'events', 'overlapping_intervals', count(*) FILTER (nx IS NOT NULL AND (b IS NULL OR nx <= b)) FROM io""")
query("D3_history_audit", lambda m: quality.audit_history(m.calendar, m.index_members, m.industries.where("valid_to IS NULL"), "1995-01-01", "2001-11-30"), "table rule", "bad_rows", ints="bad_rows", ctes="cal members signals",
      sql="""SELECT 'calendar' AS "table", 'incomplete_history' AS rule, 0 AS bad_rows UNION ALL SELECT 'index_members', 'dates_without_complete_weights', 0 UNION ALL
        SELECT 'industries', 'dates_with_unmapped_members', count(*) FROM signals WHERE signal_date < DATE '1999-01-01'""")
query("D4_stale_intervals", lambda m: quality.stale_intervals(m.index_members.withColumn("valid_to", F.when(F.col("symbol") < "S000000010", None).otherwise(F.col("valid_to")))), "index_code", "bad_rows", ints="bad_rows", ctes="members",
      sql="SELECT index_code, count(*) FILTER (symbol < 'S000000010' AND valid_from < (SELECT max(valid_from) FROM members)) AS bad_rows FROM members GROUP BY 1")
query("D4_reassessment", lambda m: quality.reassessment({**bundle(m), "industries": m.industries.withColumn("industry_code", F.when(F.col("industry_code") == "I2", "UNKNOWN").otherwise(F.col("industry_code")))}, index_code=INDEX_CODE), "table rule severity", "bad_rows", ints="bad_rows", ctes="industries",
      sql=f"""SELECT 'industries' AS "table", 'UNKNOWN_INDUSTRY' AS rule, 'error' AS severity, count(*) AS bad_rows FROM industries WHERE industry_code = 'I2' UNION ALL SELECT 'fundamentals', 'INVALID_FINANCIAL_AVAILABILITY', 'error', 0
        UNION ALL SELECT 'fundamentals', 'FINANCIAL_VINTAGES_UNVERIFIED', 'warning', 1 UNION ALL SELECT 'index_members', 'STALE_INDEX_INTERVAL', 'error', 0""")
query("D4_snapshot_counts", lambda m: quality.snapshot_against_intervals(m.index_members, "1999-03-15"), "index_code", "interval_count snapshot_count interval_weight snapshot_weight", ints="interval_count snapshot_count", ctes="members",
      sql="""SELECT index_code, count(*) FILTER (valid_to IS NULL OR valid_to >= DATE '1999-03-15') AS interval_count, count(*) AS snapshot_count, sum(benchmark_weight) AS interval_weight, sum(benchmark_weight) AS snapshot_weight FROM members
        WHERE valid_from = (SELECT max(valid_from) FROM members WHERE valid_from <= DATE '1999-03-15') GROUP BY 1""")
query("D5_panel_factors", lambda m: quality.check_panel(panel(m, NAMES[:2]), NAMES[:2]).groupBy("factor_name").agg(F.count(F.lit(1)).alias("n")), "factor_name", "n", ints="n", ctes=CTES, extra=PANEL,
      sql="SELECT factor_name, count(*) AS n FROM pan WHERE factor_name IN ('MOMENTUM_60D', 'REVERSAL_5D') GROUP BY 1")
query("D7_disclosure_rules", lambda m: fundamentals.check_disclosures(m.fundamentals.withColumn("available_date", F.date_sub("available_date", 60))), "rule", "bad_rows", ints="bad_rows", ctes="fund",
      sql="""SELECT 'null_key' AS rule, 0 AS bad_rows UNION ALL SELECT 'released_before_period_end', count(*) FROM fund WHERE available_date - 60 < stat_date UNION ALL SELECT 'conflicting_revision', 0""")
query("D8_key_nulls", lambda m: changelog.key_violations(m.table("events").select(F.when(F.col("value") > 100, F.col("user_id")).alias("user_id"), "event_id"), ["user_id", "event_id"]), "key_column", "null_rows", ints="null_rows",
      sql="SELECT 'user_id' AS key_column, count(*) FILTER (value <= 100) AS null_rows FROM events UNION ALL SELECT 'event_id', 0")
query("D9_run_coverage", lambda m: quality.run_coverage(m.trades.select(F.col("symbol").alias("factor_name"), F.col("trade_date").alias("signal_date")), "2001-12-01", 30), "factor_name last_date covered", ctes="trades",
      sql="SELECT symbol AS factor_name, max(trade_date) AS last_date, DATE '2001-12-01' - max(trade_date) <= 30 AS covered FROM trades GROUP BY 1")


def run_rows(m):
    return m.table("orders").select(F.col("o_custkey").alias("factor_id"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"),
                                    F.date_sub("o_orderdate", 700).alias("run_start"), F.to_date("o_orderdate").alias("run_end"))


query("D10_missing_runs", lambda m: quality.missing_runs(m.table("customer").select(F.col("c_custkey").alias("factor_id")), run_rows(m), "1998-06-01", "1999-06-01"), "factor_id",
      extra={"ls": "SELECT o_custkey, o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1"},
      sql="SELECT c_custkey AS factor_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM ls WHERE d - 700 <= DATE '1998-06-01' AND d >= DATE '1999-06-01')")


# --- sets and incremental ------------------------------------------------------------------------


def user_months(m):
    month = F.trunc("o_orderdate", "MM")
    return m.table("orders").select(F.col("o_custkey").alias("factor_name"), month.alias("first_month"), F.add_months(month, F.when(F.col("o_orderstatus") == "F", 2).otherwise(0)).alias("last_month"))


MONTHS = {"um": "SELECT o_custkey AS factor_name, date_trunc('month', o_orderdate)::DATE AS a, (date_trunc('month', o_orderdate) + CASE WHEN o_orderstatus = 'F' THEN INTERVAL 2 MONTH ELSE INTERVAL 0 MONTH END)::DATE AS b FROM orders",
          "mo": "SELECT DISTINCT factor_name, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS mth FROM um"}
query("U6_merged_ranges", lambda m: incremental.merge_month_ranges(user_months(m), ["factor_name"]), "factor_name first_month last_month", extra=MONTHS,
      sql="""SELECT factor_name, min(mth) AS first_month, max(mth) AS last_month FROM (SELECT *, date_diff('month', DATE '1990-01-01', mth) - row_number() OVER (PARTITION BY factor_name ORDER BY mth) AS g FROM mo) GROUP BY factor_name, g""")


def required(m):
    return m.table("customer").select(F.col("c_custkey").alias("factor_name"), F.lit("1997-01-01").cast("date").alias("first_month"), F.lit("1997-12-01").cast("date").alias("last_month"))


REQ = {**MONTHS, "rq": "SELECT c_custkey AS factor_name, unnest(generate_series(DATE '1997-01-01', DATE '1997-12-01', INTERVAL 1 MONTH))::DATE AS month FROM customer", "mi": "SELECT * FROM rq WHERE NOT EXISTS (SELECT 1 FROM mo WHERE mo.factor_name = rq.factor_name AND mth = month)"}
query("U7_missing_months", lambda m: incremental.missing_months(required(m), user_months(m), ["factor_name"]), "factor_name month", extra=REQ, sql="SELECT * FROM mi")
query("U8_coverage", lambda m: incremental.covered(required(m), user_months(m), ["factor_name"]), "factor_name covered", "required_months missing_months", ints="required_months missing_months", extra=REQ,
      sql="SELECT rq.factor_name, count(mi.month) = 0 AS covered, count(*) AS required_months, count(mi.month) AS missing_months FROM rq LEFT JOIN mi USING (factor_name, month) GROUP BY 1")
query("D12_cache_status", lambda m: incremental.cache_status(required(m), m.table("orders").select(F.col("o_custkey").alias("factor_name"), F.to_date("o_orderdate").alias("signal_date"))), "covered", "factors", ints="factors",
      extra={"so": "SELECT DISTINCT o_custkey AS f, date_trunc('month', o_orderdate) AS mth FROM orders WHERE year(o_orderdate) = 1997"},
      sql="SELECT n = 12 AS covered, count(*) AS factors FROM (SELECT c_custkey, count(mth) AS n FROM customer LEFT JOIN so ON f = c_custkey GROUP BY 1) GROUP BY 1")
query("U1_union_by_name", lambda m: performance.union_all([m.table("customer").select(F.col("c_custkey").alias("k"), "c_acctbal"), m.table("supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")]), "k", "c_acctbal s_acctbal",
      sql="SELECT c_custkey AS k, c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
query("U2_without_repeats", lambda m: panels.without_repeats(m.table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("factor_name"), "o_orderkey"), m.table("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("factor_name"), "o_orderkey")), "factor_name o_orderkey",
      sql="SELECT o_custkey AS factor_name, o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
query("U3_symbol_sets", lambda m: m.trades.where("l_quantity > 48").select("symbol", "trade_date").intersect(m.status.where("is_suspended = false").select("symbol", "trade_date")).exceptAll(m.status.where("is_st").select("symbol", "trade_date")), "symbol trade_date", ctes="trades status",
      sql="SELECT symbol, trade_date FROM trades WHERE l_quantity > 48 INTERSECT SELECT symbol, trade_date FROM status WHERE NOT is_suspended EXCEPT SELECT symbol, trade_date FROM status WHERE is_st")
query("U4_last_wins", lambda m: pit.newest(m.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"]), "o_custkey o_orderkey", "o_totalprice",
      sql="SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")


def cached(m, late):
    rows = m.table("orders").select(F.col("o_orderpriority").alias("factor_name"), F.trunc("o_orderdate", "MM").alias("signal_date"), F.col("o_custkey").alias("symbol"), F.col("o_totalprice").alias("raw_value"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("r2" if late else "r1")).otherwise("r1").alias("revision"),
                                    F.col("o_orderkey").alias("k")).where((F.col("o_orderstatus") == "F") if late else (F.col("o_orderstatus") != "F"))
    return pit.newest(rows, ["factor_name", "signal_date", "symbol"], ["k"]).drop("k")


UP = {"ca": "SELECT o_orderpriority AS f, date_trunc('month', o_orderdate)::DATE AS d, o_custkey AS s, o_totalprice AS v, o_orderstatus = 'F' AS late FROM orders QUALIFY row_number() OVER (PARTITION BY f, d, s, late ORDER BY o_orderkey DESC) = 1"}
query("U5_upsert_values", lambda m: incremental.upsert_values(cached(m, False), cached(m, True)), "factor_name signal_date symbol revision", "raw_value", extra=UP,
      sql="SELECT f AS factor_name, d AS signal_date, s AS symbol, CASE WHEN f = '1-URGENT' THEN 'r2' ELSE 'r1' END AS revision, v AS raw_value FROM ca WHERE late OR f <> '1-URGENT' QUALIFY row_number() OVER (PARTITION BY f, d, s ORDER BY late DESC) = 1")
query("U9_signature_rows", lambda m: incremental.data_signature({"calendar": m.calendar, "events": m.events}).select("table", "rows"), "table", "rows", ints="rows", ctes="cal events_adj",
      sql="""SELECT 'calendar' AS "table", count(*) AS rows FROM cal UNION ALL SELECT 'events', count(*) FROM events_adj""")
query("U10_pivot_melt", lambda m: library.melt(m.trades.groupBy("symbol").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")), ["A", "N", "R"], ["symbol"]), "symbol factor_name", "raw_value", ctes="trades",
      sql="SELECT symbol, l_returnflag AS factor_name, sum(l_quantity) AS raw_value FROM trades GROUP BY 1, 2")
query("U11_grown_schema", lambda m: changelog.grow(m.table("events").where("event_id < 5000").select("event_id", "value"), m.table("events").where("event_id >= 5000").select("event_id", "value", "event_type")), "event_id event_type", "value",
      sql="SELECT event_id, CASE WHEN event_id >= 5000 THEN event_type END AS event_type, value FROM events")

# --- streams ---------------------------------------------------------------------------------


def scratch(m, name):
    return f"{scratch_folder(m.spark)}/{name}-{uuid.uuid4().hex}"


def synced_events(m):
    """A log that already holds two publications takes the rest of the events from files."""
    source = m.table("events").select("event_id", "user_id", "event_type", "value")
    folder = scratch(m, "sync")
    landing, log = f"{folder}/landing", changelog.Log(m.spark, f"{folder}/log")
    for k in (0, 1):
        log.publish(source.where(F.col("event_id") % 6 == k), ["user_id"], "upsert", "event_id")
    source.where("event_id % 6 > 1").repartition(4, "event_id").write.parquet(landing)
    sync.append_batches(m.spark, landing, source.schema, ["user_id"], log.folder, f"{folder}/checkpoint", sequence="event_id").awaitTermination()
    return log.read(["user_id"], by=changelog.ORDERS["sequence"])


query("ST1_synced_events", synced_events, "event_id user_id event_type", "value", sql="SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")


def streamed_replay(m):
    folder = scratch(m, "replay")
    m.fundamentals.write.parquet(f"{folder}/in")
    schema = m.spark.read.parquet(f"{folder}/in").schema
    stream = m.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    job = replay.replay(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return replay.newest(m.spark.read.parquet(f"{folder}/out"))


query("ST2_streamed_replay", streamed_replay, "symbol available_date", list(FE), ctes="fund", extra=REPLAY, digits=4, sql=f"SELECT symbol, signal_date AS available_date, {', '.join(f'{v} AS {k}' for k, v in FE.items())} FROM x")

# --- custom operators -----------------------------------------------------------------------------


def custom(m):
    if "mean_range" not in library.CUSTOM:
        library.register_operator("mean_range", lambda df, out: df.groupBy("symbol").agg(F.avg(F.col("high") - F.col("low")).alias(out)))
    return library.operator("mean_range")(m.raw_daily, "x")


query("UF1_custom_operator", custom, "symbol", "x", ctes="raw_daily", sql="SELECT symbol, avg(high - low) AS x FROM raw_daily GROUP BY 1")


def stored_model(m):
    """A frozen model saved as an object, loaded again, and applied to the rows after its training."""
    names = ["VOLATILITY_20D"]
    wide = stored(models.feature_matrix(panel(m, names), names))
    meta = models.frozen(wide, names, PERIODS, "ols", label_ends=asof.label_end_dates(m.month_ends, m.calendar), hot=m.hot())[1]
    fitted, end = meta["model"], dt.date.fromisoformat(PERIODS["development"][1])
    estimator = stored_models.LinearEstimator(np.array(fitted.coefficients), fitted.intercept, np.array([meta["imputation"][n] for n in names]))
    folder = scratch(m, "models")
    stored_models.save(m.spark, folder, estimator, "volatility", "1", end, names)
    model = stored_models.load(m.spark, folder, "volatility", "1")
    return stored_models.apply(wide.where(F.col("signal_date") > F.lit(end)), model)


query("UF2_model_plugin", stored_model, "signal_date symbol", "prediction", ctes=CTES, extra={**PANEL, **ONE}, sql="SELECT signal_date, symbol, a + b * iv AS prediction FROM f2, f3 WHERE signal_date > DATE '1998-12-31'")
query("UF3_grouped_function", lambda m: m.trades.groupBy("symbol").agg(F.product(1 + F.col("l_tax") / 100).alias("x")), "symbol", "x", ctes="trades", sql="SELECT symbol, product(1 + l_tax / 100) AS x FROM trades GROUP BY 1")
query("UF4_row_expansion", lambda m: m.table("part").select("p_partkey", F.explode(F.sequence(F.lit(1), (F.col("p_size") % 5 + 1))).alias("layer")), "p_partkey", "layer", ints="layer", sql="SELECT p_partkey, unnest(range(1, p_size % 5 + 2)) AS layer FROM part")

# --- end to end ---------------------------------------------------------------------------------


def backtest(m, names=("MOMENTUM_60D", "BP_MRQ")):
    m = m.stored()
    return research.backtest_factors(m.bars, m.fundamentals, m.calendar, list(names), PERIODS, signals=m.month_ends, forward=m.marked_forward)


query("E1_backtest_metrics", lambda m: backtest(m)["metrics"], f"{VARIANT} period cost_scenario metric_name", "metric_value")
x("E1_backtest_prices", lambda m: backtest(m, ["MOMENTUM_60D", "REVERSAL_5D"])["metrics"], f"{VARIANT} period cost_scenario metric_name", "metric_value", f"SELECT * FROM ({COST_ROWS}) WHERE value_type = 'raw' AND factor_name IN ('MOMENTUM_60D', 'REVERSAL_5D')",
  {**MONTHLY, "bo": SUMMARY["bo"], **COST}, neutral=True, digits=6)
x("E2_panel_backtest", lambda m: research.backtest_panel(panel(m, ["VOLATILITY_20D"]), PERIODS, hot=m.hot())["performance"], f"{VARIANT} period portfolio", "annualized_return information_ratio",
  f"SELECT *, ph AS period FROM perf JOIN ex USING ({PKC}, ph) WHERE value_type = 'raw' AND factor_name = 'VOLATILITY_20D'", {**MONTHLY, **LONG, **LAYER}, neutral=True, digits=6)
query("E3_audited_factors", lambda m: research.audited_factors({**bundle(m.stored()), "daily": m.stored().daily}, ["REVERSAL_5D"], m.month_ends), "signal_date symbol factor_name", "raw_value", ctes=CTES, extra=PANEL,
      sql="SELECT signal_date, symbol, factor_name, raw_value FROM lg WHERE factor_name = 'REVERSAL_5D'")


def report(m):
    m = m.stored()
    names = sorted(r["factor_name"] for r in kept_names(m).collect())
    if not names:
        raise ValueError("no factor is left to report")
    p = panel(m, names)
    used = sorted(r["factor_name"] for r in p.select("factor_name").distinct().collect())
    return research.combination(p, p.select("factor_name").distinct().withColumn("direction", F.lit("unknown")), PERIODS, used, methods=("equal", "ic_decay", "max_icir"), hot=m.hot())["summary"]


query("E5_report", report, f"{VARIANT} period", "rank_ic icir coverage")


def schedule(m, frequency, per_year):
    m = m.stored()
    signals = m.month_ends if frequency == "monthly" else asof.signal_dates(m.calendar, frequency)
    plan = asof.holding_plan(signals, m.calendar)
    forward = cut(asof.forward_mark_returns(m.bars, plan, m.calendar))
    values = library.compute_factors(m.bars, None, signals, ["MOMENTUM_60D", "REVERSAL_5D"])
    scores = cut(values.select("signal_date", "symbol", F.col("factor_name").alias("method"), F.col("raw_value").alias("score")))
    caps = pit.latest_on_dates(m.daily, signals, ["float_market_cap"])
    return research.schedule_comparison(scores, forward, plan, caps, PERIODS, 10, frequency, per_year, m.hot())


SCHED = "schedule method scenario period"
SVALS = "periods annualized_return annualized_excess_return information_ratio annual_turnover annual_slippage_cost"
MONTH_SQL, WEEK_SQL = schedule_sql("monthly", 12.0), schedule_sql("weekly", 52.0)
FAC = {k: v for k, v in PANEL.items() if k not in ("af", "lg", "pan")}
TABLES = "rt signals calnext cal bars daily"
query("E6_monthly_schedule", lambda m: schedule(m, "monthly", 12.0), SCHED, SVALS, ints="periods", ctes=TABLES, extra={**FAC, **MONTH_SQL[0]}, sql=MONTH_SQL[1], digits=6)
query("E7_weekly_schedule", lambda m: schedule(m, "weekly", 52.0), SCHED, SVALS, ints="periods", ctes=TABLES, extra={**FAC, **WEEK_SQL[0]}, sql=WEEK_SQL[1], digits=6)


def comparison(m):
    """Two schedules in one table: the exploratory grid."""
    m = m.stored()
    return schedule(m, "monthly", 12.0).unionByName(schedule(m, "weekly", 52.0))


BOTH = {**FAC, **MONTH_SQL[0], **WEEK_SQL[0]}
query("E8_schedule_grid", comparison, SCHED, SVALS, ints="periods", ctes=TABLES, extra=BOTH, sql=f"SELECT * FROM ({MONTH_SQL[1]}) UNION ALL SELECT * FROM ({WEEK_SQL[1]})", digits=6)
query("E9_grid_check", lambda m: research.report_check(schedule(m, "monthly", 12.0), SCHED.split(), 24), "complete", "rows unique_rows", ints="rows unique_rows", ctes=TABLES, extra={**FAC, **MONTH_SQL[0], "ta": MONTH_SQL[1]},
      sql="SELECT count(*) = 24 AND count(DISTINCT (schedule, method, scenario, period)) = 24 AS complete, count(*) AS rows, count(DISTINCT (schedule, method, scenario, period)) AS unique_rows FROM ta")


def explored(m):
    wide = cut(models.feature_matrix(panel(m), NAMES))
    runs = research.model_run(wide, NAMES, PERIODS, ["ols", "lasso"], protocol="walk_forward", hot=m.hot())
    return evaluate.evaluate_batch(cut(runs), PERIODS, value_types=["raw"], hot=m.hot())[1]


query("E10_model_exploration", explored, f"{VARIANT} period", "rank_ic icir hac_t")


def backfilled(m):
    """Stored values of one factor; only the factor that is missing is computed."""
    folder = scratch(m, "values")
    m = m.stored()
    need = m.month_ends.agg(F.trunc(F.min("signal_date"), "MM").alias("first_month"), F.trunc(F.max("signal_date"), "MM").alias("last_month"))

    def compute(names, window):
        return library.compute_factors(m.bars, None, m.month_ends, names).select("factor_name", "signal_date", "symbol", "raw_value")

    one = need.withColumn("factor_name", F.lit("REVERSAL_5D"))
    incremental.fill_missing(m.spark, folder, one, "r1", compute, None)
    both = need.withColumn("factor_name", F.explode(F.array(F.lit("REVERSAL_5D"), F.lit("MOMENTUM_60D"))))
    incremental.fill_missing(m.spark, folder, both, "r1", compute, m.spark.read.parquet(folder))
    return m.spark.read.parquet(folder)


query("E11_backfilled_values", backfilled, "signal_date symbol factor_name revision", "raw_value", ctes=CTES, extra=PANEL, sql="SELECT signal_date, symbol, factor_name, 'r1' AS revision, raw_value FROM lg WHERE factor_name IN ('REVERSAL_5D', 'MOMENTUM_60D')")


def equity_study(m):
    m = m.stored()
    p = cut(panels.labelled_members(m, ["REVERSAL_5D", "TURNOVER_MEAN_5D", "VOLATILITY_20D"], m.marked_forward))
    signs = p.select("factor_name").distinct().withColumn("sign", F.lit(1.0))
    return portfolio.portfolio_metrics(cut(portfolio.quintile_portfolios(p, signs, asof.benchmark_forward(m.index_daily, m.month_end_plan), PERIODS, minimum=5, hot=m.hot())), ["index_code", "factor_name"])


query("E12_equity_study", equity_study, "index_code factor_name period", "months mean_turnover mean_net_return net_information_ratio sharpe", ints="months", ctes=f"{MEMBER_CTES} plan bars", digits=6,
      extra={**member_sql(["REVERSAL_5D", "TURNOVER_MEAN_5D", "VOLATILITY_20D"]), **QUINT, "z1": "SELECT *, raw_value AS s FROM pan WHERE raw_value IS NOT NULL AND forward_return IS NOT NULL", "z3": QUINT["z3"].replace("n >= 25", "n >= 5")},
      sql=f"""SELECT '{INDEX_CODE}' AS index_code, factor_name, ph AS period, count(*) AS months, avg(turnover) AS mean_turnover, avg(group_1 - cost) AS mean_net_return,
        avg(group_1 - cost - benchmark_return) * 12 / nullif(stddev_samp(group_1 - cost - benchmark_return) * sqrt(12), 0) AS net_information_ratio, avg(group_1 - cost) * 12 / nullif(stddev_samp(group_1 - cost) * sqrt(12), 0) AS sharpe
        FROM (SELECT *, unnest(['all', CASE WHEN signal_date <= DATE '1998-12-31' THEN 'development' WHEN signal_date <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END]) AS ph FROM q1) GROUP BY factor_name, ph""")


def signal(m, upto="9999-12-31"):
    scores = panel(m, ["VOLATILITY_20D"]).select("signal_date", "symbol", F.col("raw_value").alias("score"))
    return research.export_signal(scores.where(F.col("signal_date") <= F.lit(upto).cast("date")), m.calendar, 20, hot=m.hot())


def signal_files(m):
    """The list and the record, written and read back."""
    folder = scratch(m, "signal")
    frames = signal(m)
    research.write_signal(*frames, folder)
    return [tables.read_frame(m.spark, f"{folder}/{name}.csv", df.schema) for name, df in zip(("targets", "state"), frames, strict=True)]


TARGETS = ("signal_date symbol", "score target_weight place",
  "SELECT *, raw_value AS score, 1.0 / count(*) OVER () AS target_weight FROM (SELECT *, row_number() OVER (ORDER BY raw_value DESC, symbol) AS place FROM pan WHERE factor_name = 'VOLATILITY_20D' AND raw_value IS NOT NULL AND signal_date = (SELECT max(signal_date) FROM pan) QUALIFY place <= 20)")
x("E13_signal_list", lambda m: signal(m)[0], *TARGETS, ints="place")
x("S18_signal_targets", lambda m: signal_files(m)[0], *TARGETS, ints="place")
query("S18_signal_record", lambda m: signal_files(m)[1], "signal_date effective_date next_signal_date latest_data", "names stale_days", ints="names stale_days", ctes="signals cal",
      sql="SELECT max(signal_date) AS signal_date, NULL::DATE AS effective_date, NULL::DATE AS next_signal_date, max(trade_date) AS latest_data, 20 AS names, max(trade_date) - max(signal_date) AS stale_days FROM signals, cal")


x("S18_signal_record_past", lambda m: signal(m, "1999-06-30")[1], "signal_date effective_date next_signal_date latest_data", "names stale_days",
  """SELECT s.signal_date, next_session AS effective_date, (SELECT min(signal_date) FROM signals WHERE signal_date > s.signal_date) AS next_signal_date, (SELECT max(trade_date) FROM cal) AS latest_data,
    (SELECT least(20, count(*)) FROM pan WHERE factor_name = 'VOLATILITY_20D' AND raw_value IS NOT NULL AND signal_date = s.signal_date) AS names, (SELECT max(trade_date) FROM cal) - s.signal_date AS stale_days
    FROM (SELECT max(signal_date) AS signal_date FROM signals WHERE signal_date <= DATE '1999-06-30') s JOIN calnext ON trade_date = s.signal_date""", ints="names stale_days")


def layers(m):
    m = m.stored()
    values = library.compute_factors(m.bars, None, m.month_ends, ["VOLATILITY_20D"])
    return research.factor_layers(m.daily, m.index_members, m.securities, m.status, m.calendar, m.industries, m.month_ends, values, -1.0, INDEX_CODE, m.hot())


query("E14_factor_layers", layers, "signal_date symbol industry_code layer", "target_weight", ints="layer")
query("J6_layer_inputs", lambda m: layers(m).groupBy("signal_date").agg(F.countDistinct("symbol").alias("n"), F.sum("target_weight").alias("w")), "signal_date", "n w", ints="n")


def feature_store(m):
    """Features written by year and read back."""
    folder = scratch(m, "features")
    wide = models.feature_matrix(panel(m, ["VOLATILITY_20D"]), ["VOLATILITY_20D"]).withColumn("year", F.year("signal_date"))
    wide.join(asof.label_end_dates(m.month_ends, m.calendar), "signal_date", "left").hint("rebalance", "year").write.partitionBy("year").parquet(folder)
    return m.spark.read.parquet(folder)


query("M22_feature_store", feature_store, "signal_date symbol", "VOLATILITY_20D year", ints="year", ctes=CTES, extra=PANEL, sql="SELECT signal_date, symbol, year(signal_date) AS year, raw_value AS VOLATILITY_20D FROM pan WHERE factor_name = 'VOLATILITY_20D'")
query("P13_panel_filter", lambda m: models.feature_matrix(panel(m, NAMES[:2]).where(F.col("factor_name") == "REVERSAL_5D"), ["REVERSAL_5D"], index_code="ALL_A"), "signal_date symbol", "REVERSAL_5D", ctes=CTES, extra=PANEL,
      sql="SELECT signal_date, symbol, raw_value AS REVERSAL_5D FROM pan WHERE factor_name = 'REVERSAL_5D'")
query("P15_visible_history", lambda m: pit.disclosures_on(m.fundamentals, "2000-06-30").groupBy("symbol").agg(F.count(F.lit(1)).alias("periods"), F.max("stat_date").alias("newest")), "symbol newest", "periods", ints="periods", ctes="fund",
      sql="SELECT symbol, max(stat_date) AS newest, count(DISTINCT stat_date) AS periods FROM fund WHERE available_date <= DATE '2000-06-30' GROUP BY 1")
def stored_weights(m):
    """Weights of four methods from one stored IC history."""
    from quantloom.catalog.portfolios import ic_history
    from quantloom.operators import combine

    return combine.methods_table(cut(ic_history(m)), ["equal", "ic_decay", "max_ic", "max_icir"])


query("E4_weights_from_history", stored_weights, "factor_name method", "weight")
query("S24_published_versions", lambda m: changelog.versions(event_log(m)), (), "current_version", ints="current_version", sql="SELECT max(event_id // 250) AS current_version FROM events")


def written_log(m):
    """Events through all write modes: everything, then replaced, upserted and appended parts."""
    log = scratch(m, "log")
    rows = m.table("events").select("user_id", "event_id", "value")
    changelog.publish(m.spark, log, rows, ["user_id"], "upsert", "event_id")
    changelog.publish(m.spark, log, rows.where("value < 50"), ["user_id"], "replace", "event_id")
    changelog.publish(m.spark, log, rows.where("value >= 50 AND value < 100"), ["user_id"], "upsert", "event_id")
    live = changelog.Log(m.spark, log).read(["user_id"], columns=["user_id"])
    changelog.publish(m.spark, log, rows.where("value >= 100").join(live, "user_id", "left_anti"), ["user_id"], "append", "event_id")
    return changelog.Log(m.spark, log).read(["user_id"])


query("S24_written_log", written_log, "user_id event_id", "value",
      extra={"ver": "SELECT user_id, event_id, value, CASE WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS v, count(*) FILTER (value < 100) OVER (PARTITION BY user_id) AS seen FROM events"},
      sql="SELECT * FROM ver WHERE v < 3 OR seen = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id DESC) = 1")
