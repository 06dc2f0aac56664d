"""Sources S, predicates P and scalar functions C."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.catalog.registry import query
from quantloom.functions import scalar as c
from quantloom.operators import asof, pit
from quantloom.sources import changelog, loading, tables, vendor
from quantloom.session import scratch_folder
from quantloom.sources.market import INDEX_CODE, PERIODS
from quantloom.streaming import sync

KEY = "symbol trade_date"
START, END = "1997-01-01", "1999-12-31"


def bundle(m):
    return {n: getattr(m, n) for n in ("daily", "adjustments", "calendar", "securities", "status", "fundamentals", "industries", "index_members")}


def between(column, low, high):
    return f"{column} BETWEEN DATE '{low}' AND DATE '{high}'"


# --- S ---------------------------------------------------------------------------
query("S1_contract_scan", lambda m: tables.conform(m.raw_daily, "daily"), KEY, "open high low close volume amount turnover float_market_cap",
      ctes="raw_daily", digits=5, sql="SELECT *, NULL::DOUBLE AS turnover, NULL::DOUBLE AS float_market_cap FROM raw_daily")
query("S2_nested_to_json", lambda m: tables.nested_to_json(m.table("events").select("event_id", F.struct("user_id", "event_type").alias("who"))),
      "event_id who", sql="""SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS who FROM events""")
query("S3_alias_bundle", lambda m: tables.rename_aliases(m.raw_daily.select(F.col("trade_date").alias("date"), F.col("symbol").alias("code"), "close")),
      KEY, "close", ctes="raw_daily", sql="SELECT symbol, trade_date, close FROM raw_daily")


def encoded_files(m):
    """Bars as fixed-width file contents, one per security."""

    def encode(bars: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros(len(bars), dtype=vendor.RECORD)
        rows["seconds"] = pd.to_datetime(bars["trade_date"]).astype("datetime64[s]").astype("int64")
        for name in ("open", "high", "low", "close"):
            rows[name] = (bars[name] * 1000).astype("int64")
        rows["volume"], rows["amount"] = bars["volume"], bars["amount"].astype("int64")
        content = b"\0" * vendor.HEADER_BYTES + rows.tobytes()
        return pd.DataFrame({"symbol": [bars["symbol"].iloc[0]], "length": [len(content)], "content": [content]})

    return m.raw_daily.groupBy("symbol").applyInPandas(encode, "symbol string, length long, content binary")


query("S4_fixed_width_bars", lambda m: vendor.decode_bars(encoded_files(m)), KEY, "open high low close volume amount", ctes="raw_daily", digits=4,
      sql="""SELECT symbol, trade_date, trunc(open * 1000) / 1000 AS open, trunc(high * 1000) / 1000 AS high, trunc(low * 1000) / 1000 AS low,
        trunc(close * 1000) / 1000 AS close, volume, trunc(amount) AS amount FROM raw_daily""")
query("S5_frequency_inputs", lambda m: loading.frequency_inputs(bundle(m), START, END), KEY, "adj_open adj_close turnover float_market_cap", ctes="bars", digits=5,
      sql=f"SELECT * FROM bars WHERE trade_date BETWEEN DATE '{START}' - 600 AND DATE '{END}' + 15")
query("S6_adjusted_market", lambda m: loading.adjusted_market(bundle(m), START, END), KEY + " is_suspended limit_up limit_down", "adj_open adj_close", ctes="bars status", digits=5,
      sql=f"SELECT * FROM bars JOIN status USING (symbol, trade_date) WHERE {between('trade_date', START, END)}")
query("S7_research_daily", lambda m: loading.research_daily(bundle(m), START, END, lookback=60, extra=["turnover"]), KEY, "adj_close adj_high turnover", ctes="bars", digits=5,
      sql=f"SELECT * FROM bars WHERE trade_date BETWEEN DATE '{START}' - 135 AND DATE '{END}' + 70")
query("S8_filtered_daily",
      lambda m: loading.filtered_daily(m.raw_daily, START, END, m.index_members.select("symbol").distinct(), m.status.select("trade_date", "symbol", "is_suspended")),
      KEY + " is_suspended", "close", ctes="raw_daily status members",
      sql=f"""SELECT d.symbol, d.trade_date, s.is_suspended, d.close FROM raw_daily d LEFT JOIN status s USING (symbol, trade_date)
        WHERE {between('d.trade_date', START, END)} AND d.symbol IN (SELECT symbol FROM members)""")


def event_log(m):
    """Events as a change log: 250 events per publication, every tenth one a replace."""
    version = F.floor(F.col("event_id") / 250)
    return m.table("events").select(
        "user_id", "event_type", "value", version.alias("_version"), F.col("event_id").alias("_row"),
        F.when(version % 10 == 0, "replace").otherwise("upsert").alias("_mode"))


LOG = {"log": "SELECT user_id, event_type, value, event_id // 250 AS ver, event_id FROM events",
       "live": """SELECT * FROM log WHERE ver <= 37 AND ver >= (SELECT max(ver) FROM log WHERE ver <= 37 AND ver % 10 = 0)
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ver DESC, event_id DESC) = 1"""}
query("S9_versioned_read", lambda m: changelog.read(event_log(m), ["user_id"], as_of=37, filters=[("event_type", "!=", "error")]),
      "user_id event_type", "value", extra=LOG, sql="SELECT * FROM live WHERE event_type <> 'error'")
query("S10_versioned_count", lambda m: changelog.read(event_log(m), ["user_id"], as_of=37).agg(F.count(F.lit(1)).alias("n")), (), "n", ints="n",
      extra=LOG, sql="SELECT count(*) AS n FROM live")


def compacted_log(m, order):
    """Events in five publications, the second a replacement; compacted after the third."""
    log = changelog.Log(m.spark, f"{scratch_folder(m.spark)}/log-{uuid.uuid4().hex}")
    rows = m.table("events").select("user_id", "event_type", "value", "event_id")
    for k in range(5):
        log.publish(rows.where(F.floor(F.col("event_id") / 100) % 5 == k), ["user_id"], "replace" if k == 1 else "upsert", "event_id")
        if k == 2:
            log.compact(["user_id"], order)
    return log


PUB = {"pub": "SELECT user_id, event_type, value, event_id, (event_id // 100) % 5 AS ver FROM events WHERE (event_id // 100) % 5 >= 1"}
NEWEST = "SELECT * FROM pub WHERE ver <= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ver DESC, event_id DESC) = 1"
query("S9_compacted_read", lambda m: compacted_log(m, "version").read(["user_id"], as_of=3, filters=[("event_type", "!=", "error")]), "user_id event_id event_type", "value", extra=PUB,
      sql=f"SELECT * FROM ({NEWEST}) WHERE event_type <> 'error'")
query("S9_compacted_by_sequence", lambda m: compacted_log(m, "sequence").read(["user_id"], by=changelog.ORDERS["sequence"]), "user_id event_id event_type", "value", extra=PUB,
      sql="SELECT * FROM pub QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
query("S10_compacted_count", lambda m: compacted_log(m, "version").read(["user_id"], as_of=3, columns=["user_id"]).agg(F.count(F.lit(1)).alias("n")), (), "n", ints="n", extra=PUB,
      sql=f"SELECT count(*) AS n FROM ({NEWEST})")
query("S27_footer_bounds", lambda m: tables.footer_summary(m.spark, f"{m.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]), (), "rows first_l_orderkey last_l_orderkey first_l_quantity last_l_quantity", ints="rows first_l_orderkey last_l_orderkey",
      sql="SELECT count(*) AS rows, min(l_orderkey) AS first_l_orderkey, max(l_orderkey) AS last_l_orderkey, min(l_quantity) AS first_l_quantity, max(l_quantity) AS last_l_quantity FROM lineitem")
query("S11_pinned_version", lambda m: changelog.pinned({"events": event_log(m)}, {"events": ["user_id", "event_type"]}, 12)["events"],
      "user_id event_type", "value", extra={"log": LOG["log"]}, sql="""SELECT * FROM log WHERE ver <= 12 AND ver >= 10
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ver DESC, event_id DESC) = 1""")
query("S12_table_read", lambda m: tables.read_table(m.raw_daily, ["symbol", "trade_date", "close"], [[("volume", ">=", 40.0)], [("close", "<", 21.0), ("volume", "not in", [1.0, 2.0])]]),
      KEY, "close", ctes="raw_daily", sql="SELECT * FROM raw_daily WHERE volume >= 40 OR (close < 21 AND volume NOT IN (1, 2))")
query("S16_fingerprint_rows", lambda m: tables.fingerprint(m.calendar).select("rows"), (), "rows", ints="rows", ctes="cal", sql="SELECT count(*) AS rows FROM cal")


def code(key):
    digits = F.lpad((F.lit(600000) + F.col(key)).cast("string"), 6, "0")
    return F.when(F.col(key) % 3 == 0, F.concat(F.lit("sh."), digits)).when(F.col(key) % 3 == 1, F.concat(digits, F.lit(".sh"))).otherwise(digits)


def contract(m):
    li = m.trades
    month = F.trunc("trade_date", "MM")
    big = li.where(F.col("l_quantity") >= 30)
    return vendor.local_contract(
        constituents=big.select(F.lit("IDX").alias("index_code"), code("l_suppkey").alias("code"), month.alias("updateDate")).distinct(),
        stocks=m.table("supplier").select(code("s_suppkey").alias("code"), F.lit("1994-12-30").alias("ipoDate"), F.lit("not a date").alias("outDate")),
        index_daily=li.select(F.col("trade_date").cast("string").alias("date")),
        aux=m.status.select(F.col("symbol"), F.col("trade_date").alias("date"), F.col("is_st").cast("int").alias("isST"),
                            (~F.col("is_suspended")).cast("int").alias("tradestatus")).withColumn("code", code_of("symbol")),
        fundamentals=m.fundamentals.withColumnRenamed("available_date", "avail_date").withColumn("code", code_of("symbol")).drop("symbol"),
        industry=m.table("supplier").select(code("s_suppkey").alias("code"), F.when(F.col("s_nationkey") > 2, F.concat(F.lit("n"), "s_nationkey")).alias("industry"),
                                            F.lit("2001-01-01").alias("updateDate")),
    )


def code_of(symbol):
    return F.concat(F.lpad((F.lit(600000) + F.substring(symbol, 2, 9).cast("long")).cast("string"), 6, "0"), F.lit(".SH"))


CODE = "lpad((600000 + {})::VARCHAR, 6, '0') || '.SH'"
query("S17_contract_members", lambda m: contract(m)["index_members"], "index_code symbol valid_from valid_to", "benchmark_weight", ctes="trades",
      extra={"snap": f"SELECT DISTINCT {CODE.format('l_suppkey')} AS symbol, date_trunc('month', trade_date)::DATE AS valid_from FROM trades WHERE l_quantity >= 30",
             "ends": "SELECT valid_from, (lead(valid_from) OVER (ORDER BY valid_from) - INTERVAL 1 DAY)::DATE AS valid_to FROM (SELECT DISTINCT valid_from FROM snap)"},
      sql="SELECT 'IDX' AS index_code, symbol, valid_from, valid_to, 1.0 / count(*) OVER (PARTITION BY valid_from) AS benchmark_weight FROM snap JOIN ends USING (valid_from)")
query("S17_contract_industries", lambda m: contract(m)["industries"], "symbol industry_code valid_from",
      sql=f"""SELECT {CODE.format('s_suppkey')} AS symbol, CASE WHEN s_nationkey > 2 THEN 'n' || s_nationkey ELSE 'UNKNOWN' END AS industry_code, DATE '2001-01-01' AS valid_from
        FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 30)""")
query("S17_contract_status", lambda m: contract(m)["status"], "symbol trade_date is_st is_suspended", ctes="status",
      sql=f"""SELECT {CODE.format("substr(symbol, 2)::BIGINT")} AS symbol, trade_date, is_st, is_suspended FROM status
        WHERE substr(symbol, 2)::BIGINT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 30)""")


def statements(m):
    f = m.fundamentals
    base = f.select(F.col("symbol").alias("ts_code"), F.col("stat_date").cast("string").alias("end_date"), F.col("available_date").cast("string").alias("ann_date"), "*")
    indicator = base.select("ts_code", "end_date", "ann_date", F.date_add("available_date", 3).cast("string").alias("f_ann_date"), "eps", "bps", "ocfps", "roe",
                            F.when(F.month("stat_date") != 6, F.col("gross_margin")).alias("grossprofit_margin"))
    income = base.select("ts_code", "end_date", "ann_date", "revenue", F.col("net_profit").alias("n_income_attr_p"),
                         F.when(F.month("stat_date") == 3, 4).otherwise(1).alias("report_type"))
    return indicator, income


query("S20_merge_disclosures", lambda m: vendor.merge_disclosures(*statements(m)), "symbol stat_date available_date", "eps revenue gross_margin", ctes="fund", digits=4,
      extra={"st": """SELECT symbol, stat_date, available_date + 3 AS available_date, eps, NULL::DOUBLE AS revenue, CASE WHEN month(stat_date) <> 6 THEN gross_margin END AS gross_margin FROM fund
        UNION ALL SELECT symbol, stat_date, available_date, NULL, revenue, NULL FROM fund WHERE month(stat_date) <> 3"""},
      sql="""SELECT symbol, stat_date, available_date, max(e) AS eps, max(r) AS revenue, max(g) AS gross_margin FROM (SELECT symbol, stat_date, available_date,
        last_value(eps IGNORE NULLS) OVER p AS e, last_value(revenue IGNORE NULLS) OVER p AS r, last_value(gross_margin IGNORE NULLS) OVER p AS g FROM st
        WINDOW p AS (PARTITION BY symbol, stat_date ORDER BY available_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY ALL""")
query("S21_vendor_units", lambda m: vendor.market_day(m.raw_daily, m.adjustments, m.daily.select("symbol", "trade_date", "turnover", "float_market_cap"))[0],
      KEY, "volume amount turnover float_market_cap", ctes="daily", digits=0,
      sql="SELECT symbol, trade_date, volume * 100 AS volume, amount * 1000 AS amount, turnover / 100 AS turnover, float_market_cap * 10000 AS float_market_cap FROM daily")
def basics(m):
    return m.daily.select("symbol", "trade_date", "turnover", "float_market_cap")


query("S21_resumed_days", lambda m: sync.market_days(m.raw_daily, m.raw_daily.select("symbol", "trade_date", F.col("close").alias("adjust_factor")), basics(m), "2000-06-30"), KEY, "volume", ctes="daily", digits=0,
      sql="SELECT symbol, trade_date, volume * 100 AS volume FROM daily WHERE trade_date >= DATE '2000-06-30' - 7")
query("S21_bars_without_factor", lambda m: vendor.market_day(m.raw_daily, m.adjustments.where("adjust_factor > 1.02"), basics(m))[1], KEY, ctes="raw_daily adjustments",
      sql="SELECT symbol, trade_date FROM raw_daily WHERE (symbol, trade_date) NOT IN (SELECT (symbol, trade_date) FROM adjustments WHERE adjust_factor > 1.02)")
query("S22_unit_labels", lambda m: vendor.scale_units(m.daily, {"volume": "手", "turnover": "%", "amount": "元"}), KEY, "volume turnover amount", ctes="daily",
      sql="SELECT symbol, trade_date, volume * 100 AS volume, turnover * 0.01 AS turnover, amount FROM daily", digits=5)
query("S23_pit_context", lambda m: asof.attach_interval(loading.pit_context(bundle(m))[1].join(m.month_ends, "signal_date", "left_semi"), m.industries, ["industry_code"]),
      "signal_date symbol industry_code", "float_market_cap", ctes="daily industries signals", digits=4,
      sql="""SELECT d.trade_date AS signal_date, d.symbol, i.industry_code, d.float_market_cap FROM daily d JOIN signals s ON s.signal_date = d.trade_date
        LEFT JOIN industries i ON i.symbol = d.symbol AND d.trade_date >= i.valid_from AND (i.valid_to IS NULL OR d.trade_date <= i.valid_to)""")
query("S25_listings",
      lambda m: vendor.listings([m.table("supplier").select(F.when(F.col("s_nationkey") == 1, F.lit("200001.SZ")).otherwise(
          F.concat(F.lpad((F.col("s_suppkey") + 600000).cast("string"), 6, "0"), F.lit(".SH"))).alias("symbol"),
          F.lit("19950102").alias("list_date"), F.when(F.col("s_acctbal") < 0, "2001-01-31").alias("delist_date"))]),
      "symbol list_date delist_date", sql=f"""SELECT {CODE.format('s_suppkey')} AS symbol, DATE '1995-01-02' AS list_date, CASE WHEN s_acctbal < 0 THEN DATE '2001-01-31' END AS delist_date
        FROM supplier WHERE s_nationkey <> 1""")
query("S26_features_on_dates", lambda m: loading.features_on(m.bars.withColumnRenamed("trade_date", "signal_date"), m.month_ends, ["adj_close"]), "signal_date symbol", "adj_close",
      ctes="bars signals", sql="SELECT s.signal_date, symbol, adj_close FROM bars JOIN signals s ON s.signal_date = trade_date", digits=6)
query("S27_date_bounds", lambda m: tables.date_bounds(m.trades), "first_date last_date", ctes="trades", sql="SELECT min(trade_date) AS first_date, max(trade_date) AS last_date FROM trades")
query("S28_member_market", lambda m: loading.adjusted_market(bundle(m), symbols=m.index_members.select("symbol").distinct()), KEY, "adj_open", ctes="bars members", digits=6,
      sql="SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM members)")

# --- P ---------------------------------------------------------------------------
AT = "1999-06-30"
query("P1_dnf_filter", lambda m: m.trades.where(tables.filter_column(m.trades, [[("l_returnflag", "in", ["R", "A"]), ("l_quantity", "<=", 3.0)], [("l_discount", "==", 0.07), ("l_linestatus", "!=", "O")]]))
      .groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "n", ints="n", ctes="trades",
      sql="SELECT symbol, count(*) AS n FROM trades WHERE (l_returnflag IN ('R', 'A') AND l_quantity <= 3) OR (l_discount = 0.07 AND l_linestatus <> 'O') GROUP BY symbol")
NEWEST = f"""SELECT * FROM fund WHERE available_date <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY symbol, stat_date ORDER BY available_date DESC) = 1"""
query("P2_disclosures_on_date", lambda m: pit.point_in_time(m.fundamentals, AT), "symbol stat_date available_date", "revenue", ctes="fund", sql=NEWEST, digits=4)
query("P2_intervals_on_date", lambda m: pit.point_in_time(m.industries, AT), "symbol industry_code valid_from", ctes="industries",
      sql=f"SELECT * FROM industries WHERE valid_from <= DATE '{AT}' AND (valid_to IS NULL OR valid_to >= DATE '{AT}')")
query("P3_visible", lambda m: pit.visible(m.fundamentals, AT, "stat_date", "available_date").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "n", ints="n", ctes="fund",
      sql=f"SELECT symbol, count(*) AS n FROM fund WHERE stat_date <= DATE '{AT}' AND available_date <= DATE '{AT}' GROUP BY symbol")
query("P4_universe_filter", lambda m: pit.in_universe(m.raw_daily, pit.intervals_on(m.index_members, AT)), KEY, "close", ctes="raw_daily members",
      sql=f"SELECT * FROM raw_daily WHERE symbol IN (SELECT symbol FROM members WHERE valid_from <= DATE '{AT}' AND (valid_to IS NULL OR valid_to >= DATE '{AT}'))")
query("P5_latest_daily", lambda m: pit.latest_row(m.raw_daily, AT), KEY, "close", ctes="raw_daily",
      sql=f"SELECT * FROM raw_daily WHERE trade_date <= DATE '{AT}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1")
query("P5_latest_disclosure", lambda m: pit.latest_disclosure(m.fundamentals, AT), "symbol stat_date available_date", "bps", ctes="fund", digits=4,
      sql=f"SELECT * FROM ({NEWEST}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY stat_date DESC) = 1")
query("P6_universe", lambda m: pit.universe(m.raw_daily, m.month_ends, members=m.index_members, index_code=INDEX_CODE, industries=m.industries,
                                            exclude_industries=["I0", "I3"], exclude_symbols=["S000000005"]), "signal_date symbol",
      ctes="raw_daily signals members industries", sql="""SELECT s.signal_date, d.symbol FROM signals s JOIN raw_daily d ON d.trade_date = s.signal_date
        WHERE EXISTS (SELECT 1 FROM members x WHERE x.symbol = d.symbol AND x.valid_from <= s.signal_date AND (x.valid_to IS NULL OR x.valid_to >= s.signal_date))
        AND NOT EXISTS (SELECT 1 FROM industries x WHERE x.symbol = d.symbol AND x.valid_from <= s.signal_date AND (x.valid_to IS NULL OR x.valid_to >= s.signal_date) AND x.industry_code IN ('I0', 'I3'))
        AND d.symbol <> 'S000000005'""")
LISTED = "(SELECT count(*) FROM cal WHERE cal.trade_date >= q.list_date AND cal.trade_date <= s.signal_date)"
query("P7_eligible", lambda m: pit.eligible(m.month_ends, INDEX_CODE, m.index_members, m.securities, m.status, m.calendar), "signal_date symbol", "listed_sessions", ints="listed_sessions",
      ctes="signals members securities status cal", sql=f"""SELECT * FROM (SELECT s.signal_date, x.symbol, {LISTED} AS listed_sessions
        FROM signals s JOIN members x ON x.valid_from <= s.signal_date AND (x.valid_to IS NULL OR x.valid_to >= s.signal_date)
        JOIN securities q ON q.symbol = x.symbol LEFT JOIN status t ON t.symbol = x.symbol AND t.trade_date = s.signal_date
        WHERE (q.delist_date IS NULL OR q.delist_date > s.signal_date) AND q.list_date <= s.signal_date AND NOT coalesce(t.is_st, false) AND NOT coalesce(t.is_pt, false)) WHERE listed_sessions >= 250""")
query("P8_known_status", lambda m: pit.tradable_status(asof.active_on_dates(m.index_members, m.month_ends, ["symbol"]), m.status), "signal_date symbol", ctes="signals members status",
      sql="""SELECT s.signal_date, x.symbol FROM signals s JOIN members x ON x.valid_from <= s.signal_date AND (x.valid_to IS NULL OR x.valid_to >= s.signal_date)
        JOIN status t ON t.symbol = x.symbol AND t.trade_date = s.signal_date WHERE NOT is_st AND NOT is_suspended""")
query("P9_priced_pool", lambda m: pit.priced_pool(m.daily, m.securities, m.calendar, m.month_ends), "signal_date symbol", "float_market_cap listed_sessions", ints="listed_sessions",
      ctes="daily signals securities cal", digits=4, sql=f"""SELECT * FROM (SELECT s.signal_date, d.symbol, d.float_market_cap, {LISTED} AS listed_sessions FROM signals s JOIN daily d ON d.trade_date = s.signal_date
        JOIN securities q ON q.symbol = d.symbol WHERE d.close > 0 AND d.float_market_cap > 0) WHERE listed_sessions >= 250""")
query("P10_share_codes", lambda m: m.table("part").select("p_partkey", F.lpad((F.col("p_partkey") * 457 % 1000000).cast("string"), 6, "0").alias("number"),
                                                          F.element_at(F.array(F.lit("SH"), F.lit("SZ"), F.lit("BJ")), (F.col("p_size") % 3 + 1).cast("int")).alias("ex"))
      .where(c.listed_share("number", "ex")), "p_partkey number ex", sql="""SELECT * FROM (SELECT p_partkey, lpad((p_partkey * 457 % 1000000)::VARCHAR, 6, '0') AS number,
        ['SH', 'SZ', 'BJ'][p_size % 3 + 1] AS ex FROM part) WHERE (ex = 'SH' AND left(number, 3) IN ('600', '601', '603', '605', '688', '689'))
        OR (ex = 'SZ' AND left(number, 3) IN ('000', '001', '002', '003', '300', '301')) OR (ex = 'BJ' AND left(number, 1) IN ('4', '8'))""")
query("P11_index_members", lambda m: loading.index_members(m.index_members, [INDEX_CODE]), "index_code symbol valid_from", ctes="members", sql="SELECT * FROM members")
query("P12_valid_bars", lambda m: m.trades.select("symbol", "trade_date", F.col("price").alias("close"), (F.col("price") * (1 + F.col("l_discount") - 0.05)).alias("open"),
                                                  (F.col("price") * (1 + F.col("l_tax") / 2)).alias("high"), F.col("price").alias("low"), F.col("l_quantity").alias("volume"),
                                                  F.col("l_extendedprice").alias("amount")).where(pit.holds()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "n", ints="n",
      ctes="trades", sql="""SELECT symbol, count(*) AS n FROM (SELECT symbol, price AS c, price * (1 + l_discount - 0.05) AS o, price * (1 + l_tax / 2) AS h, price AS l FROM trades)
        WHERE h >= greatest(o, c, l) AND l <= least(o, c, h) AND least(o, h, l, c) > 0 GROUP BY symbol""")
query("P14_assign_period", lambda m: m.calendar.select("trade_date", pit.period("trade_date", {**PERIODS, "test": ("2000-01-01", "2000-12-31")}).alias("period")), "trade_date period", ctes="cal",
      sql="""SELECT trade_date, CASE WHEN trade_date <= DATE '1998-12-31' THEN 'development' WHEN trade_date <= DATE '1999-12-31' THEN 'validation'
        WHEN trade_date <= DATE '2000-12-31' THEN 'test' END AS period FROM cal""")
query("P16_open_dates", lambda m: asof.open_dates(m.trades.select("trade_date", (F.col("l_returnflag") != "A").alias("is_open"))), "trade_date", ctes="trades",
      sql="SELECT DISTINCT trade_date FROM trades WHERE l_returnflag <> 'A'")
query("P17_industry_options", lambda m: pit.industry_options(m.industries.withColumn("industry_code", F.when(F.col("industry_code") == "I4", "unknown").otherwise(F.col("industry_code")))),
      "industry_code industry_name", ctes="industries", sql="SELECT DISTINCT industry_code, industry_name FROM industries WHERE industry_code <> 'I4'")

# --- C ---------------------------------------------------------------------------
query("C1_security_code", lambda m: m.table("supplier").select("s_suppkey", c.security_code(code("s_suppkey")).alias("symbol")), "s_suppkey symbol",
      sql=f"SELECT s_suppkey, {CODE.format('s_suppkey')} AS symbol FROM supplier")
query("C2_safe_ratio", lambda m: m.trades.groupBy("symbol").agg(F.sum(c.ratio("l_tax", "l_discount")).alias("x")), "symbol", "x", ctes="trades",
      sql="SELECT symbol, sum(l_tax / nullif(l_discount, 0)) AS x FROM trades GROUP BY symbol", digits=5)
query("C3_local_day", lambda m: m.table("events").select("event_id", c.local_day(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("local_date")), "event_id local_date",
      sql="SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE AS local_date FROM events")
query("C4_parse_day", lambda m: m.table("orders").select("o_orderkey", c.day(F.when(F.col("o_orderstatus") == "F", F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("d")),
      "o_orderkey d", sql="SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate::DATE END AS d FROM orders")
query("C5_period_keys", lambda m: m.calendar.select("trade_date", *[c.period_key("trade_date", k).alias(n) for k, n in (("W-FRI", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year"))]),
      "trade_date week month quarter year", ctes="cal", sql="""SELECT trade_date, (trade_date + ((12 - isodow(trade_date)) % 7)::INT)::DATE AS week, last_day(trade_date) AS month,
        last_day((date_trunc('quarter', trade_date) + INTERVAL 2 MONTH)::DATE) AS quarter, make_date(year(trade_date), 12, 31) AS year FROM cal""")
query("C6_year_arithmetic", lambda m: m.calendar.select("trade_date", c.year_earlier("trade_date").alias("year_ago"), c.prior_year_end("trade_date").alias("prior_fy")),
      "trade_date year_ago prior_fy", ctes="cal", sql="SELECT trade_date, (trade_date - INTERVAL 1 YEAR)::DATE AS year_ago, make_date(year(trade_date) - 1, 12, 31) AS prior_fy FROM cal")
query("C7_numeric_coercion", lambda m: m.table("events").select("event_id", c.number(F.when(F.col("event_type") == "click", F.lit("x1")).otherwise(F.col("value").cast("string"))).alias("x")),
      "event_id", "x", sql="SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS x FROM events")
query("C8_conditional_math", lambda m: m.bars.select("symbol", "trade_date", F.signum(F.col("adj_close") - F.col("adj_open")).alias("s"), c.clip(F.col("close") / F.col("open") - 1, -0.1, 0.1).alias("x")),
      KEY, "s x", ctes="bars", sql="SELECT symbol, trade_date, sign(adj_close - adj_open) AS s, greatest(-0.1, least(0.1, close / open - 1)) AS x FROM bars")
query("C9_json_values", lambda m: m.table("events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), (), "k n", ints="k n",
      sql="SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
query("C10_digest", lambda m: m.table("orders").select("o_orderkey", c.digest("o_orderkey", "o_orderpriority").alias("sha")), "o_orderkey sha",
      sql="SELECT o_orderkey, sha256(o_orderkey || chr(31) || o_orderpriority) AS sha FROM orders")


def orders_as_trades(m):
    return m.table("orders").select("o_orderkey", F.date_add("o_orderdate", 9000).alias("d"), F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("o_totalprice").alias("notional"))


ORD = {"o": "SELECT o_orderkey, (o_orderdate::DATE + 9000)::DATE AS d, CASE WHEN o_custkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_totalprice AS notional FROM orders"}
query("C11_fees", lambda m: orders_as_trades(m).select("o_orderkey", *[x.alias(n) for n, x in c.fees("d", "side", "notional", minimum_commission=5.0).items()]), "o_orderkey",
      "commission stamp_tax transfer_fee", extra=ORD, sql="""SELECT o_orderkey, greatest(5.0, notional * 0.0003) AS commission,
        CASE WHEN side = 'buy' THEN 0 WHEN d >= DATE '2023-08-28' THEN notional * 0.0005 ELSE notional * 0.001 END AS stamp_tax,
        notional * CASE WHEN d >= DATE '2022-04-29' THEN 0.00001 ELSE 0.00002 END AS transfer_fee FROM o""")
query("C12_turnover_cost", lambda m: (lambda d: d.select("o_orderkey", *[x.alias(n) for n, x in zip(("cost", "stress_cost"), c.turnover_cost("d", F.col("notional") / 1e6, F.col("notional") / 2e6))]))(orders_as_trades(m)),
      "o_orderkey", "cost stress_cost", extra=ORD, sql="""SELECT o_orderkey, n * 1.5 * (0.0008 + t) + n / 2 * s AS cost, n * 1.5 * (0.0013 + t) + n / 2 * s AS stress_cost FROM (SELECT o_orderkey, notional / 1e6 AS n,
        CASE WHEN d >= DATE '2022-04-29' THEN 0.00001 ELSE 0.00002 END AS t, CASE WHEN d >= DATE '2023-08-28' THEN 0.0005 ELSE 0.001 END AS s FROM o)""")
