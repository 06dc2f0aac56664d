"""Joins J, disclosures, registered factors R and batch panels W."""

from pyspark.sql import functions as F

from quantloom.catalog.registry import query
from quantloom.catalog.sql import W, lagged, over, roll
from quantloom.catalog.technical import RAW
from quantloom.operators import asof, fundamentals, library, pit
from quantloom.operators.technical import ALL_NAMES
from quantloom.plans import panels
from quantloom.sources.market import INDEX_CODE

SIGNAL = "signal_date symbol"

# --- disclosures -------------------------------------------------------------------
FIELDS = ("revenue", "net_profit", "eps", "bps", "ocfps", "roe", "gross_margin")
SEEN = {
    "seen": "SELECT d.trade_date AS signal_date, d.symbol, d.close, d.float_market_cap FROM daily d JOIN signals s ON s.signal_date = d.trade_date",
    "vis": """SELECT s.signal_date, f.* FROM signals s JOIN fund f ON f.available_date <= s.signal_date
      QUALIFY row_number() OVER (PARTITION BY s.signal_date, symbol, stat_date ORDER BY available_date DESC) = 1""",
    "lat": "SELECT signal_date, symbol, max(stat_date) AS sd FROM vis GROUP BY ALL",
    "st": f"""SELECT signal_date, symbol, stat_date, roe, gross_margin, net_profit,
      CASE WHEN count(roe) OVER e >= 6 THEN -stddev_samp(roe) OVER e END AS roe_stab,
      CASE WHEN count(gross_margin) OVER e >= 6 THEN -stddev_samp(gross_margin) OVER e END AS gm_stab,
      {', '.join(f'lag({f}) OVER q AS {f}_pq' for f in FIELDS)}, net_profit / nullif(lag(net_profit) OVER q, 0) - 1 AS g FROM vis
      WINDOW q AS (PARTITION BY signal_date, symbol ORDER BY stat_date), e AS (PARTITION BY signal_date, symbol ORDER BY stat_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "st2": """SELECT *, CASE WHEN count(g) OVER e >= 7 THEN -stddev_samp(g) OVER e END AS g_stab FROM st
      WINDOW e AS (PARTITION BY signal_date, symbol ORDER BY stat_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "x": "SELECT l.signal_date, l.symbol, month(l.sd) AS mon, " + ", ".join(f"c.{f} AS {f}, pf.{f} AS {f}_fy, ps.{f} AS {f}_ps, st2.{f}_pq" for f in FIELDS) + """,
      st2.roe_stab, st2.gm_stab, st2.g_stab
      FROM lat l JOIN vis c ON c.signal_date = l.signal_date AND c.symbol = l.symbol AND c.stat_date = l.sd
      JOIN st2 ON st2.signal_date = l.signal_date AND st2.symbol = l.symbol AND st2.stat_date = l.sd
      LEFT JOIN vis pf ON pf.signal_date = l.signal_date AND pf.symbol = l.symbol AND pf.stat_date = make_date(year(l.sd) - 1, 12, 31)
      LEFT JOIN vis ps ON ps.signal_date = l.signal_date AND ps.symbol = l.symbol AND ps.stat_date = (l.sd - INTERVAL 1 YEAR)::DATE""",
}


def ttm(f):
    return f"(CASE WHEN mon = 12 THEN {f} ELSE {f} + {f}_fy - {f}_ps END)"


def yoy(f, difference=False):
    return f"({f} - {f}_ps)" if difference else f"({f} / nullif(abs({f}_ps), 0) - 1)"


def seen_sql(columns: dict[str, str]) -> dict:
    body = ", ".join(f"{sql} AS {n}" for n, sql in columns.items())
    return {"sql": f"SELECT signal_date, symbol, {body} FROM seen LEFT JOIN x USING (signal_date, symbol)", "ctes": "daily signals fund", "extra": SEEN}


def seen(m):
    return m.daily.select(F.col("trade_date").alias("signal_date"), "symbol", "close", "float_market_cap").join(m.month_ends, "signal_date", "left_semi")


def filed(m, **expressions):
    released = fundamentals.events(m.fundamentals, expressions, FIELDS)
    return fundamentals.attach_events(seen(m), released, list(expressions))


query("A2_mrq", lambda m: filed(m, x=fundamentals.latest("bps")), SIGNAL, "x", **seen_sql({"x": "bps"}), digits=6)
query("A3_ttm", lambda m: filed(m, x=fundamentals.ttm("revenue"), y=fundamentals.ttm("eps")), SIGNAL, "x y", **seen_sql({"x": ttm("revenue"), "y": ttm("eps")}), digits=4)
query("A4_yoy", lambda m: filed(m, x=fundamentals.yoy("revenue"), y=fundamentals.yoy("roe", True)), SIGNAL, "x y", **seen_sql({"x": yoy("revenue"), "y": yoy("roe", True)}))
query("A5_qoq", lambda m: filed(m, x=fundamentals.qoq("revenue"), y=fundamentals.qoq("roe", True)), SIGNAL, "x y", **seen_sql({"x": "revenue / nullif(abs(revenue_pq), 0) - 1", "y": "roe - roe_pq"}))
query("A6_stability", lambda m: filed(m, x=fundamentals.stability("roe", 8, 6), y=fundamentals.stability("net_profit", 9, 7, growth=True)), SIGNAL, "x y",
      **seen_sql({"x": "roe_stab", "y": "g_stab"}))
query("A38_factor_reference", lambda m: library.wide(m.bars, None, ["MOMENTUM_60D", "VOLATILITY_60D"], m.month_ends).select(
      F.col("trade_date").alias("signal_date"), "symbol", F.try_divide("MOMENTUM_60D", "VOLATILITY_60D").alias("x")), SIGNAL, "x", ctes="rt signals",
      extra={"f": f"SELECT symbol, trade_date, c / nullif({lagged('c', 60)}, 0) - 1 AS mo, {roll('r', 60, 48, 'stddev_samp')} AS vo FROM rt"},
      sql="SELECT trade_date AS signal_date, symbol, mo / nullif(vo, 0) AS x FROM f JOIN signals s ON s.signal_date = f.trade_date")


def factor_query(name, names, **sql):
    query(name, lambda m: library.wide(m.bars, m.fundamentals, names, m.month_ends).withColumnRenamed("trade_date", "signal_date"), SIGNAL, names, **sql)


VALUE = {"EP_TTM": f"{ttm('eps')} / close", "BP_MRQ": "bps / close", "SP_TTM": f"{ttm('revenue')} / float_market_cap", "CFP_TTM": f"{ttm('ocfps')} / close"}
factor_query("R1_value", library.names("value"), **seen_sql(VALUE))
GROWTH = {"REVENUE_YOY": yoy("revenue"), "NET_PROFIT_YOY": yoy("net_profit"), "EPS_YOY": yoy("eps"), "OCFPS_YOY": yoy("ocfps"), "ROE_YOY_CHANGE": yoy("roe", True), "GROSS_MARGIN_YOY_CHANGE": yoy("gross_margin", True)}
factor_query("R2_growth", library.names("growth"), **seen_sql(GROWTH))
QUALITY = {"ROE": "roe", "GROSS_MARGIN": "gross_margin", "NET_MARGIN_TTM": f"{ttm('net_profit')} / nullif({ttm('revenue')}, 0)", "OCF_TO_EARNINGS": f"{ttm('ocfps')} / nullif({ttm('eps')}, 0)",
           "ROE_STABILITY_8Q": "roe_stab", "GROSS_MARGIN_STABILITY_8Q": "gm_stab", "EARNINGS_GROWTH_STABILITY_8Q": "g_stab"}
factor_query("R6_quality", library.names("quality"), **seen_sql(QUALITY), digits=7)


def mom(w, skip=0, sign=""):
    top = lagged("c", skip) if skip else "c"
    return f"{sign}({top} / nullif({lagged('c', w + skip)}, 0) - 1)"


BAR_SQL = {f"REVERSAL_{w}D": mom(w, sign="-") for w in (1, 2, 3, 5, 7, 10, 20)}
BAR_SQL |= {"MOMENTUM_60D": mom(60), "MOMENTUM_120D": mom(120), "MOMENTUM_120D_SKIP20": mom(120, 20), "MOMENTUM_252D_SKIP20": mom(252, 20)}
BAR_SQL |= {f"HIGH_{w}D_PROXIMITY": f"c / {roll('c', w, int(w * .8), 'max')} - 1" for w in (20, 60, 120, 252)}
BAR_SQL |= {f"TURNOVER_MEAN_{w}D": roll("turnover", w, max(1, int(w * .8))) for w in (1, 5, 7, 10, 20, 60, 120)}
BAR_SQL |= {f"TURNOVER_BIAS_{w}_480D": f"avg(turnover) {over(w)} / nullif({roll('turnover', 480, 384)}, 0) - 1" for w in (20, 60)}
BAR_SQL |= {f"TURNOVER_VOL_{w}D": roll("turnover", w, int(w * .8), "stddev_samp") for w in (5, 7, 10, 20, 60)}
BAR_SQL |= {f"AMIHUD_{w}D": f"{roll('il', w, k)} * 1e8" for w, k in ((5, 4), (7, 6), (10, 8), (20, 15))}
BAR_SQL |= {f"VOLATILITY_{w}D": roll("r", w, max(1, int(w * .8)), "stddev_samp") for w in (2, 3, 5, 7, 10, 20, 60, 120)}
for w in (10, 20, 60):
    BAR_SQL |= {f"UPSIDE_VOL_{w}D": roll("ru", w, int(w * .8), "stddev_samp"), f"DOWNSIDE_VOL_{w}D": roll("rd", w, int(w * .8), "stddev_samp")}
BAR_SQL |= {f"MAX_RETURN_{w}D": roll("r", w, int(w * .8), "max") for w in (5, 7, 10, 20)}
BAR_SQL |= {"ABS_RETURN_1D": "abs(r)"}
STAGE = {"sg": "SELECT *, abs(r) / nullif(amount, 0) AS il, CASE WHEN r < 0 THEN 0 ELSE r END AS ru, CASE WHEN r > 0 THEN 0 ELSE r END AS rd FROM rt"}
RESIDUAL = {
    "mk": "SELECT trade_date, avg(r) AS mr FROM rt GROUP BY trade_date",
    "pairs": f"SELECT symbol, trade_date, list(r) {over(60)} AS ys, list(mr) {over(60)} AS xs FROM rt JOIN mk USING (trade_date) WHERE r IS NOT NULL AND mr IS NOT NULL",
    "mean2": "SELECT *, list_avg(ys) AS my, list_avg(xs) AS mx FROM pairs WHERE len(ys) >= 48",
    "beta": """SELECT *, list_sum(list_transform(list_zip(xs, ys), lambda p: (p[1] - mx) * (p[2] - my))) / nullif(list_sum(list_transform(xs, lambda x: (x - mx) * (x - mx))), 0) AS b FROM mean2""",
    "resid": "SELECT symbol, trade_date, list_transform(list_zip(xs, ys), lambda p: (p[2] - my) - b * (p[1] - mx)) AS e FROM beta",
    "idio": "SELECT symbol, trade_date, list_aggregate(e, 'stddev_samp') AS iv, list_aggregate(e, 'skewness') AS sk FROM resid",
}


def bar_sql(names, extra=None, tail="", more=None) -> dict:
    sqls = BAR_SQL | {"IDIO_VOL_60D": "iv", "IDIO_SKEW_60D": "sk"} | (more or {})
    residual = any(n.startswith("IDIO") for n in names)
    source = "sg LEFT JOIN idio USING (symbol, trade_date)" if residual else "sg"
    body = ", ".join(f"{sqls[n]} AS {n}" for n in names)
    ctes = {**STAGE, **(RESIDUAL if residual else {}), "fac": f"SELECT symbol, trade_date, close, float_market_cap, {body} FROM {source}", **(extra or {})}
    return {"ctes": "rt signals", "extra": ctes, "sql": f"SELECT trade_date AS signal_date, * FROM fac JOIN signals s ON s.signal_date = fac.trade_date {tail}"}


for key, family in (("R3_momentum", "momentum"), ("R4_liquidity", "liquidity"), ("R5_risk", "risk")):
    factor_query(key, library.names(family), **bar_sql(library.names(family)), digits=6)

TECH = ["BIAS_20D", "ROC_12D", "WR_14D", "BOLL_MID_20D_PCT"]
query("R7_technical_panel", lambda m: panels.technical_panel(m.stored().bars, m.month_ends), SIGNAL, ALL_NAMES, ctes="raw_daily signals", digits=4,
      sql="SELECT * FROM (SELECT trade_date AS signal_date, trade_date, symbol FROM raw_daily JOIN signals ON signal_date = trade_date) "
      + " ".join(f"JOIN ({sql}) AS g{i} USING (symbol, trade_date)" for i, sql in enumerate(RAW.values())))
query("W3_technical_at_signals", lambda m: panels.technical_panel(m.bars, m.month_ends, TECH), SIGNAL, TECH, ctes="tb signals",
      extra={"f": f"""SELECT symbol, trade_date, c / {roll('c', 20, 16)} - 1 AS BIAS_20D, c / nullif({lagged('c', 12)}, 0) - 1 AS ROC_12D,
        -100 * ({roll('h', 14, fn='max')} - c) / nullif({roll('h', 14, fn='max')} - {roll('l', 14, fn='min')}, 0) AS WR_14D, {roll('c', 20)} / c - 1 AS BOLL_MID_20D_PCT FROM tb"""},
      sql="SELECT trade_date AS signal_date, * FROM f JOIN signals s ON s.signal_date = f.trade_date")
COMPUTE = ["MOMENTUM_60D", "AMIHUD_20D", "VOLATILITY_20D", "TURNOVER_MEAN_20D"]
query("R8_compute_factors", lambda m: library.compute_factors(m.bars, m.fundamentals, m.month_ends, COMPUTE), "signal_date symbol factor_name available_date", "raw_value",
      **{**bar_sql(COMPUTE), "sql": " UNION ALL ".join(f"SELECT s.signal_date, s.symbol, '{n}' AS factor_name, s.signal_date AS available_date, {n} AS raw_value FROM (SELECT signal_date, symbol FROM signals, (SELECT DISTINCT symbol FROM fac)) s ASOF JOIN fac ON fac.symbol = s.symbol AND s.signal_date >= fac.trade_date" for n in COMPUTE)})

# --- batch panels -------------------------------------------------------------------
BATCH = {"HIGH_252D_PROXIMITY": f"c / {roll('c', 252, 200, 'max')} - 1", "AMIHUD_7D": f"{roll('il', 7, 5)} * 1e8"}
INDEX = RESIDUAL | {"ix": "SELECT trade_date, avg(adj_close) AS cl FROM bars GROUP BY trade_date", "mk": "SELECT trade_date, cl / lag(cl) OVER (ORDER BY trade_date) - 1 AS mr FROM ix"}


def member_panel(names) -> dict:
    out = bar_sql(list(names), more=BATCH)
    extra = dict(out["extra"])
    if "mk" in extra:
        extra = {**STAGE, "ix": INDEX["ix"], **{k: v for k, v in extra.items() if k not in STAGE}, "mk": INDEX["mk"]}
        order = ["sg", "ix", "mk", "pairs", "mean2", "beta", "resid", "idio", "fac"]
        extra = {k: extra[k] for k in order}
    return {"ctes": "rt signals members bars", "extra": extra, "sql": """SELECT s.signal_date, x.index_code, x.symbol, f.* EXCLUDE (symbol) FROM signals s JOIN members x ON x.valid_from <= s.signal_date AND (x.valid_to IS NULL OR x.valid_to >= s.signal_date)
      LEFT JOIN fac f ON f.symbol = x.symbol AND f.trade_date = s.signal_date"""}


def member_factors(m, names, index=False):
    m = m.stored()
    return panels.member_factors(m.bars, m.member_rows, names, m.index_daily if index else None)


query("W1_base_panel", lambda m: member_factors(m, library.BASE_PANEL, True), "signal_date symbol index_code", library.BASE_PANEL, **member_panel(library.BASE_PANEL), digits=6)
query("W2_short_panel", lambda m: member_factors(m, library.SHORT_PANEL), "signal_date symbol index_code", library.SHORT_PANEL, **member_panel(library.SHORT_PANEL), digits=6)
query("W11_index_residuals", lambda m: member_factors(m, ["IDIO_VOL_60D", "IDIO_SKEW_60D"], True), "signal_date symbol index_code",
      "IDIO_VOL_60D IDIO_SKEW_60D", **member_panel(["IDIO_VOL_60D", "IDIO_SKEW_60D"]), digits=7)
query("W12_market_returns", lambda m: asof.market_returns(m.index_daily), "index_code trade_date", "market_return", ctes="bars", extra={"ix": INDEX["ix"]},
      sql=f"SELECT '{INDEX_CODE}' AS index_code, trade_date, cl / lag(cl) OVER (ORDER BY trade_date) - 1 AS market_return FROM ix")
MF_SQL = {"AMIHUD_7D": f"{roll('il', 7, 6)} * 1e8", "ATR_14D_PCT": f"{roll('tr', 14)} / c", "BOLL_LOWER_20D_PCT": f"({roll('c', 20)} - 2 * {roll('c', 20, fn='stddev_samp')}) / c - 1",
          "DONCHIAN_WIDTH_20D": f"({roll('h', 20, fn='max')} - {roll('l', 20, fn='min')}) / c"}
MF = [n for n in library.MARKET_SET if not n.startswith("KELTNER")]
mf = bar_sql(MF, more=MF_SQL)
mf["extra"] = {"sg": STAGE["sg"].replace("SELECT *,", "SELECT *, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr,"), "fac": mf["extra"]["fac"]}
WEEKLY = "SELECT max(trade_date) AS signal_date FROM cal GROUP BY trade_date + ((12 - isodow(trade_date)) % 7)::INT HAVING (max(trade_date) + ((12 - isodow(max(trade_date))) % 7)::INT) <= (SELECT max(trade_date) FROM cal)"
mf["sql"] = mf["sql"].replace("JOIN signals s", "JOIN wk s")
mf["extra"]["wk"] = WEEKLY
mf["ctes"] = "rt cal"
query("W4_market_features_weekly", lambda m: library.market_features(m.bars, asof.signal_dates(m.calendar, "weekly"), MF), SIGNAL, [*MF, "close"], **mf, digits=6)
query("W17_weekly_signals", lambda m: asof.signal_dates(m.calendar, "weekly", "1996-01-01", "2001-06-30"), "signal_date", ctes="cal", extra={"wk": WEEKLY},
      sql="SELECT * FROM wk WHERE signal_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'")
query("W17_monthly_signals", lambda m: asof.signal_dates(m.calendar, "monthly"), "signal_date", ctes="cal",
      sql="SELECT max(trade_date) AS signal_date FROM cal GROUP BY date_trunc('month', trade_date) HAVING last_day(max(trade_date)) <= (SELECT max(trade_date) FROM cal)")
POSITIONAL = {
    "dd": "SELECT * FROM fund QUALIFY row_number() OVER (PARTITION BY symbol, stat_date ORDER BY available_date DESC) = 1",
    "p0": """SELECT *, eps / nullif(abs(lag(eps, 4) OVER w), 0) - 1 AS eps_yoy, ocfps / nullif(abs(lag(ocfps, 4) OVER w), 0) - 1 AS ocfps_yoy, roe - lag(roe, 4) OVER w AS roe_yoy_change,
      gross_margin - lag(gross_margin, 4) OVER w AS gross_margin_yoy_change, net_profit / nullif(lag(net_profit) OVER w, 0) - 1 AS g,
      CASE WHEN count(roe) OVER e >= 6 THEN -stddev_samp(roe) OVER e END AS roe_stability, CASE WHEN count(gross_margin) OVER e >= 6 THEN -stddev_samp(gross_margin) OVER e END AS gross_margin_stability, """
      + ", ".join(f"CASE WHEN count({f}) OVER v >= 4 THEN sum({f}) OVER v END AS {f}_ttm" for f in ("eps", "ocfps", "net_profit", "revenue"))
      + """ FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY stat_date), v AS (PARTITION BY symbol ORDER BY stat_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
      e AS (PARTITION BY symbol ORDER BY stat_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "p1": """SELECT *, net_profit_ttm / nullif(revenue_ttm, 0) AS net_margin_ttm, ocfps_ttm / nullif(eps_ttm, 0) AS ocf_to_earnings, CASE WHEN count(g) OVER e >= 6 THEN -stddev_samp(g) OVER e END AS earnings_growth_stability
      FROM p0 WINDOW e AS (PARTITION BY symbol ORDER BY stat_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
}
POS = ["eps_yoy", "ocfps_yoy", "roe_yoy_change", "gross_margin_yoy_change", "eps_ttm", "revenue_ttm", "net_margin_ttm", "ocf_to_earnings", "roe_stability", "gross_margin_stability", "earnings_growth_stability"]
query("W5_positional_features", lambda m: fundamentals.positional_features(m.fundamentals), "symbol stat_date", POS, ctes="fund", extra=POSITIONAL, sql="SELECT * FROM p1", digits=4)
PF = {n: (f"p1.{f} / close" if n in library.fundamentals.PER_PRICE else f"p1.{f}") for n, f in fundamentals.PANEL_FIELDS.items()}
query("W6_panel_fundamentals", lambda m: fundamentals.panel_factors(seen(m), m.fundamentals, "close"), SIGNAL, list(PF), ctes="daily signals fund",
      extra={**{k: SEEN[k] for k in ("seen",)}, **POSITIONAL,
             "lp": "SELECT seen.signal_date, seen.symbol, max(p1.stat_date) AS sd FROM seen JOIN p1 ON p1.symbol = seen.symbol AND p1.available_date <= seen.signal_date GROUP BY ALL"},
      sql=f"""SELECT seen.signal_date, seen.symbol, {', '.join(f'{v} AS {k}' for k, v in PF.items())} FROM seen LEFT JOIN lp USING (signal_date, symbol)
        LEFT JOIN p1 ON p1.symbol = seen.symbol AND p1.stat_date = lp.sd""", digits=7)
REPLAY = SEEN | {
    "signals2": "SELECT DISTINCT symbol AS es, available_date AS signal_date FROM fund",
    "vis": """SELECT s.signal_date, f.* FROM signals2 s JOIN fund f ON f.symbol = s.es AND f.available_date <= s.signal_date
      QUALIFY row_number() OVER (PARTITION BY s.signal_date, symbol, stat_date ORDER BY available_date DESC) = 1""",
}
REPLAY = {k: REPLAY[k] for k in ("signals2", "vis", "lat", "st", "st2", "x")}
FE = {"bps": "bps", "revenue_ttm": ttm("revenue"), "ocfps_ttm": ttm("ocfps"), "revenue_yoy": yoy("revenue"), "net_profit_yoy": yoy("net_profit"), "roe_stability": "roe_stab", "gross_margin_stability": "gm_stab"}
query("W14_financial_events", lambda m: fundamentals.financial_events(m.fundamentals), "symbol available_date", list(FE), ctes="fund", extra=REPLAY, digits=4,
      sql=f"SELECT symbol, signal_date AS available_date, {', '.join(f'{v} AS {k}' for k, v in FE.items())} FROM x")
J3 = {"BP_MRQ": "bps / close", "SP_TTM": f"{ttm('revenue')} / float_market_cap", "CFP_TTM": f"{ttm('ocfps')} / close", "ROE_STABILITY_8Q": "roe_stab", "GROSS_MARGIN_STABILITY_8Q": "gm_stab",
      "REVENUE_YOY": yoy("revenue"), "NET_PROFIT_YOY": yoy("net_profit")}
query("J3_financial_features", lambda m: fundamentals.add_financial_features(seen(m), fundamentals.financial_events(m.fundamentals)), SIGNAL, list(J3), **seen_sql(J3))

# --- joins -----------------------------------------------------------------------------
query("J2_latest_disclosure_asof", lambda m: asof.attach_latest(m.raw_daily.select("symbol", "trade_date"), pit.newest(m.fundamentals, ["symbol", "available_date"], ["stat_date"]),
      right_time="available_date", columns=["bps", "stat_date"]), "symbol trade_date stat_date", "bps", ctes="raw_daily fund",
      extra={"fa": "SELECT * FROM fund QUALIFY row_number() OVER (PARTITION BY symbol, available_date ORDER BY stat_date DESC) = 1"}, digits=6,
      sql="SELECT d.symbol, d.trade_date, f.stat_date, f.bps FROM raw_daily d ASOF LEFT JOIN fa f ON f.symbol = d.symbol AND d.trade_date >= f.available_date")
query("J4_industry_on_dates", lambda m: asof.active_on_dates(m.industries, m.month_ends, ["symbol", "industry_code"]), "signal_date symbol industry_code", ctes="industries signals",
      sql="SELECT s.signal_date, symbol, industry_code FROM industries i JOIN signals s ON s.signal_date >= valid_from AND (valid_to IS NULL OR s.signal_date <= valid_to)")
query("J5_signal_members", lambda m: m.member_rows, "signal_date symbol index_code list_date", "listed_sessions", ints="listed_sessions", ctes="members signals securities cal",
      sql="""SELECT s.signal_date, x.symbol, x.index_code, q.list_date, (SELECT count(*) FROM cal WHERE cal.trade_date >= q.list_date AND cal.trade_date <= s.signal_date) AS listed_sessions
        FROM members x JOIN signals s ON s.signal_date >= x.valid_from AND (x.valid_to IS NULL OR s.signal_date <= x.valid_to) JOIN securities q ON q.symbol = x.symbol""")
MEMBER_LABEL = """SELECT s.signal_date, x.symbol, f.entry_date, f.exit_date, f.forward_return FROM members x JOIN signals s ON s.signal_date >= x.valid_from AND (x.valid_to IS NULL OR s.signal_date <= x.valid_to)
  LEFT JOIN forward f ON f.signal_date = s.signal_date AND f.symbol = x.symbol"""
query("J7_label_attach", lambda m: m.member_rows.join(m.forward, ["signal_date", "symbol"], "left"), "signal_date symbol entry_date exit_date", "forward_return", ctes="members signals forward", sql=MEMBER_LABEL)
BASE4 = ["MOMENTUM_60D", "REVERSAL_5D"]
LONG = " UNION ALL ".join(f"SELECT trade_date AS signal_date, symbol, '{n}' AS factor_name, {n} AS raw_value FROM fac JOIN signals s ON s.signal_date = fac.trade_date" for n in BASE4)
b4 = bar_sql(BASE4)
query("J8_assembled_panel", lambda m: library.labelled_panel(library.compute_factors(m.bars, None, m.month_ends, BASE4, traded=True), m.forward, INDEX_CODE, asof.active_on_dates(m.index_members, m.month_ends, ["symbol"])),
      "signal_date symbol factor_name index_code", "raw_value forward_return", ctes="rt signals members forward", extra={**b4["extra"], "lg": LONG},
      sql=f"""SELECT l.*, '{INDEX_CODE}' AS index_code, f.forward_return FROM lg l LEFT JOIN forward f USING (signal_date, symbol)
        WHERE EXISTS (SELECT 1 FROM members x WHERE x.symbol = l.symbol AND x.valid_from <= l.signal_date AND (x.valid_to IS NULL OR x.valid_to >= l.signal_date))
        AND (f.symbol IS NOT NULL OR l.signal_date NOT IN (SELECT signal_date FROM forward))""")
query("J9_latest_month_kept", lambda m: library.labelled_panel(library.compute_factors(m.bars, None, m.month_ends, ["REVERSAL_5D"], traded=True), m.forward).groupBy("signal_date").agg(
      F.count("raw_value").alias("n"), F.count("forward_return").alias("labelled")), "signal_date", "n labelled", ints="n labelled", ctes="rt signals forward", extra={**b4["extra"], "lg": LONG},
      sql="""SELECT signal_date, count(raw_value) AS n, count(forward_return) AS labelled FROM lg LEFT JOIN forward f USING (signal_date, symbol)
        WHERE factor_name = 'REVERSAL_5D' AND (f.symbol IS NOT NULL OR signal_date NOT IN (SELECT signal_date FROM forward)) GROUP BY 1""")
query("J10_status_at_execution", lambda m: m.forward.join(m.status.withColumnRenamed("trade_date", "entry_date"), ["entry_date", "symbol"], "left"), "signal_date symbol is_suspended limit_up limit_down", ctes="forward status",
      sql="SELECT f.signal_date, f.symbol, is_suspended, limit_up, limit_down FROM forward f LEFT JOIN status s ON s.symbol = f.symbol AND s.trade_date = f.entry_date")
query("J11_benchmark_forward", lambda m: asof.benchmark_forward(m.index_daily, m.month_end_plan), "index_code signal_date", "benchmark_return", ctes="plan bars",
      extra={"ix": "SELECT trade_date, avg(adj_open) AS op FROM bars GROUP BY trade_date"},
      sql=f"SELECT '{INDEX_CODE}' AS index_code, signal_date, b.op / a.op - 1 AS benchmark_return FROM plan JOIN ix a ON a.trade_date = entry_date JOIN ix b ON b.trade_date = exit_date")
query("J12_market_return_join", lambda m: m.raw_daily.select("symbol", "trade_date").withColumn("index_code", F.lit(INDEX_CODE)).join(asof.market_returns(m.index_daily), ["index_code", "trade_date"], "left"),
      "symbol trade_date", "market_return", ctes="bars", extra={"ix": INDEX["ix"], "mk": INDEX["mk"]}, sql="SELECT symbol, trade_date, mr AS market_return FROM bars LEFT JOIN mk USING (trade_date)")
query("J13_inner_align", lambda m: library.wide(m.bars, None, ["MOMENTUM_60D", "VOLATILITY_20D"], m.month_ends).dropna().withColumnRenamed("trade_date", "signal_date"), SIGNAL, "MOMENTUM_60D VOLATILITY_20D",
      **{**bar_sql(["MOMENTUM_60D", "VOLATILITY_20D"]), "sql": "SELECT trade_date AS signal_date, * FROM fac JOIN signals s ON s.signal_date = fac.trade_date WHERE MOMENTUM_60D IS NOT NULL AND VOLATILITY_20D IS NOT NULL"})
query("J14_uncovered_bars", lambda m: m.raw_daily.join(m.events, ["symbol", "trade_date"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "n", ints="n", ctes="raw_daily events_adj",
      sql="SELECT symbol, count(*) AS n FROM raw_daily d WHERE NOT EXISTS (SELECT 1 FROM events_adj e WHERE e.symbol = d.symbol AND e.trade_date = d.trade_date) GROUP BY symbol")
query("J16_dense_grid", lambda m: asof.densify(m.month_ends, m.securities.select("symbol"), "signal_date"), SIGNAL, ctes="signals securities", sql="SELECT signal_date, symbol FROM signals, securities")
query("W16_label_end_dates", lambda m: asof.label_end_dates(m.month_ends, m.calendar), "signal_date label_end_date", ctes="plan", sql="SELECT signal_date, exit_date AS label_end_date FROM plan")
query("W19_next_open", lambda m: asof.next_open(m.calendar.select(F.date_add("trade_date", -1).alias("signal_date")), m.calendar), "signal_date execution_date", ctes="cal",
      sql="SELECT (trade_date - 1)::DATE AS signal_date, trade_date AS execution_date FROM cal")
query("W20_next_month_signal", lambda m: asof.next_month_signal(m.month_ends, m.calendar), "signal_date next_signal_date", ctes="signals cal",
      sql="""SELECT a.signal_date, CASE WHEN last_day((date_trunc('month', a.signal_date) + INTERVAL 1 MONTH)::DATE) <= (SELECT max(trade_date) FROM cal) THEN b.signal_date END AS next_signal_date
        FROM signals a LEFT JOIN signals b ON date_trunc('month', b.signal_date) = date_trunc('month', a.signal_date) + INTERVAL 1 MONTH""")
query("W23_carried_marks", lambda m: asof.carry_marks(m.bars, m.calendar, sessions=60), "symbol trade_date observed", "mark", ctes="bars cal securities", digits=6,
      sql=f"""SELECT symbol, trade_date, q IS NOT NULL AS observed, coalesce(last_value(q IGNORE NULLS) OVER ({W} ROWS BETWEEN 60 PRECEDING AND CURRENT ROW), 0) AS mark
        FROM (SELECT g.symbol, g.trade_date, b.adj_open AS q FROM (SELECT symbol, trade_date FROM securities, cal) g LEFT JOIN bars b USING (symbol, trade_date))""")
LABELLED = {"mm": MEMBER_LABEL}
query("W26_labelled_member_panel", lambda m: panels.labelled_members(m.stored(), ["REVERSAL_5D", "TURNOVER_MEAN_5D"]), "signal_date symbol index_code factor_name entry_date exit_date", "raw_value forward_return",
      ctes="rt signals members forward securities status cal", extra={**bar_sql(["REVERSAL_5D", "TURNOVER_MEAN_5D"])["extra"], "mm": MEMBER_LABEL,
        "el": """SELECT mm.*, fac.REVERSAL_5D, fac.TURNOVER_MEAN_5D FROM mm JOIN fac ON fac.symbol = mm.symbol AND fac.trade_date = mm.signal_date JOIN status t ON t.symbol = mm.symbol AND t.trade_date = mm.signal_date
          JOIN securities q ON q.symbol = mm.symbol WHERE NOT is_st AND NOT is_suspended AND (SELECT count(*) FROM cal WHERE cal.trade_date >= q.list_date AND cal.trade_date <= mm.signal_date) >= 250""",
        "lo": "SELECT signal_date, symbol, entry_date, exit_date, forward_return, unnest(['REVERSAL_5D', 'TURNOVER_MEAN_5D']) AS factor_name, unnest([REVERSAL_5D, TURNOVER_MEAN_5D]) AS v FROM el",
        "m1": "SELECT *, median(v) OVER p AS md FROM lo WINDOW p AS (PARTITION BY signal_date, factor_name)",
        "m2": "SELECT *, median(abs(v - md)) OVER p AS mad FROM m1 WINDOW p AS (PARTITION BY signal_date, factor_name)",
        "m3": "SELECT *, CASE WHEN coalesce(mad, 0) = 0 THEN v ELSE greatest(md - 5 * mad, least(md + 5 * mad, v)) END AS wv FROM m2"},
      sql=f"SELECT *, '{INDEX_CODE}' AS index_code, (wv - avg(wv) OVER p) / nullif(stddev_pop(wv) OVER p, 0) AS raw_value FROM m3 WINDOW p AS (PARTITION BY signal_date, factor_name)")
