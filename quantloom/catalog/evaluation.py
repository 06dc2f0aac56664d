"""Cross-sections and evaluation X1-X38."""

from pyspark.sql import functions as F

from quantloom.catalog.panels import MEMBER_LABEL, bar_sql
from quantloom.catalog.registry import query
from quantloom.functions import groups
from quantloom.functions.tails import add_hac_t, benjamini_hochberg, two_sided_p
from quantloom.operators import asof, cross_section, evaluate, library, performance, pit
from quantloom.plans import panels
from quantloom.session import IN_PLACE, cut, settings
from quantloom.sources.market import INDEX_CODE, PERIODS

NAMES = ["MOMENTUM_60D", "REVERSAL_5D", "VOLATILITY_20D", "AMIHUD_20D"]
IDS = ["factor_name"]
PF = ["signal_date", "factor_name"]

b = bar_sql(NAMES)
PANEL = {
    **b["extra"],
    "af": "SELECT s.signal_date, fac.* FROM (SELECT signal_date, symbol FROM signals, (SELECT DISTINCT symbol FROM fac)) s ASOF JOIN fac ON fac.symbol = s.symbol AND s.signal_date >= fac.trade_date",
    "lg": " UNION ALL ".join(f"SELECT signal_date, symbol, float_market_cap, '{n}' AS factor_name, {n} AS raw_value FROM af" for n in NAMES),
    "pan": """SELECT l.*, f.forward_return, i.industry_code FROM lg l LEFT JOIN mforward f USING (signal_date, symbol)
      LEFT JOIN industries i ON i.symbol = l.symbol AND i.valid_from <= l.signal_date AND (i.valid_to IS NULL OR i.valid_to >= l.signal_date)
      WHERE f.symbol IS NOT NULL OR l.signal_date NOT IN (SELECT signal_date FROM mforward)""",
}
NEUTRAL = {
    "n1": "SELECT *, median(raw_value) OVER p AS md FROM pan WINDOW p AS (PARTITION BY signal_date, factor_name)",
    "n2": "SELECT *, median(abs(raw_value - md)) OVER p AS mad FROM n1 WINDOW p AS (PARTITION BY signal_date, factor_name)",
    "n3": "SELECT *, CASE WHEN coalesce(mad, 0) = 0 OR raw_value IS NULL THEN raw_value ELSE greatest(md - 5 * mad, least(md + 5 * mad, raw_value)) END AS wv FROM n2",
    "n4": "SELECT *, (wv - avg(wv) OVER p) / nullif(stddev_pop(wv) OVER p, 0) AS z FROM n3 WINDOW p AS (PARTITION BY signal_date, factor_name)",
    "n5": "SELECT *, CASE WHEN z IS NOT NULL AND industry_code IS NOT NULL AND float_market_cap > 0 THEN float_market_cap END AS w, ln(float_market_cap) AS lc FROM n4",
    "n6": """SELECT *, z - sum(w * z) OVER g / sum(w) OVER g AS dy, lc - sum(CASE WHEN w IS NOT NULL THEN w * lc END) OVER g / sum(w) OVER g AS dx FROM n5
      WINDOW g AS (PARTITION BY signal_date, factor_name, industry_code)""",
    "n7": """SELECT *, CASE WHEN w IS NOT NULL AND count(w) OVER p >= 3 THEN dy - CASE WHEN sum(w * dx * dx) OVER p <= 1e-12 * sum(w) OVER p THEN 0 ELSE sum(w * dx * dy) OVER p / sum(w * dx * dx) OVER p END * dx END AS res FROM n6
      WINDOW p AS (PARTITION BY signal_date, factor_name)""",
    "n8": "SELECT *, res - sum(w * res) OVER p / sum(CASE WHEN res IS NOT NULL THEN w END) OVER p AS off FROM n7 WINDOW p AS (PARTITION BY signal_date, factor_name)",
    "neu": "SELECT *, CASE WHEN max(abs(res)) OVER p > 1e-9 THEN 1 END * off / nullif(sqrt(sum(w * off * off) OVER p / sum(CASE WHEN res IS NOT NULL THEN w END) OVER p), 0) AS neutralized_value FROM n8 WINDOW p AS (PARTITION BY signal_date, factor_name)",
}
CTES = "rt signals mforward industries"


def labelled_rows(m, names=NAMES):
    """The labelled panel, not stored: for one reader."""
    m = m.stored()
    values = library.compute_factors(m.bars, m.fundamentals, m.month_ends, names)
    return library.labelled_panel(values, m.marked_forward, plan=m.month_end_plan)


def panel(m, names=NAMES, neutral=False):
    """The labelled panel, stored once: evaluation reads it several times."""
    m = m.stored()
    with settings(m.spark, IN_PLACE):  # values, labels and caps all lie by security
        return cut(_panel_rows(m, names, neutral))


def _panel_rows(m, names, neutral):
    rows = labelled_rows(m, names)
    if not neutral:
        return rows
    cap = pit.latest_on_dates(m.daily, m.month_ends, ["float_market_cap"])
    rows = asof.attach_interval(rows.drop("neutralized_value").join(cap, ["signal_date", "symbol"], "left"), m.industries, ["industry_code"])
    return cross_section.neutralize(rows, PF, hot=m.hot())


def x(name, build, keys, values, sql, extra=None, neutral=False, **kw):
    query(name, build, keys, values, ctes=CTES, extra={**PANEL, **(NEUTRAL if neutral else {}), **(extra or {})}, sql=sql, **kw)


KEYS = "signal_date symbol factor_name"
x("X1_mad_winsorize", lambda m: cross_section.mad_winsorize(panel(m), PF, "raw_value", "x", hot=m.hot()), KEYS, "x", "SELECT *, wv AS x FROM n3", {k: NEUTRAL[k] for k in ("n1", "n2", "n3")})
x("X2_zscore", lambda m: cross_section.zscore(panel(m), PF, "raw_value", "x", hot=m.hot()), KEYS, "x",
  "SELECT *, (raw_value - avg(raw_value) OVER p) / nullif(stddev_pop(raw_value) OVER p, 0) AS x FROM pan WINDOW p AS (PARTITION BY signal_date, factor_name)")
x("X2_weighted_zscore", lambda m: cross_section.zscore(panel(m, neutral=True).select("signal_date", "symbol", "factor_name", "raw_value", F.col("float_market_cap").alias("w")), PF, "raw_value", "x", weight="w", hot=m.hot()), KEYS, "x",
  "SELECT *, off / nullif(sqrt(sum(w * off * off) OVER p / sum(w) OVER p), 0) AS x FROM q2 WINDOW p AS (PARTITION BY signal_date, factor_name)",
  {"q1": "SELECT *, CASE WHEN raw_value IS NOT NULL THEN float_market_cap END AS w FROM pan", "q2": "SELECT *, raw_value - sum(w * raw_value) OVER p / sum(w) OVER p AS off FROM q1 WINDOW p AS (PARTITION BY signal_date, factor_name)"})
x("X3_standardised_panel", lambda m: cross_section.standardise(panel(m), PF, "raw_value", "z", hot=m.hot()), KEYS, "z", "SELECT * FROM n4", {k: NEUTRAL[k] for k in ("n1", "n2", "n3", "n4")})
x("X5_neutralized", lambda m: panel(m, neutral=True), KEYS, "neutralized_value", "SELECT * FROM neu", neutral=True, digits=6)
x("X6_neutral_one_factor", lambda m: panel(m, ["VOLATILITY_20D"], neutral=True), KEYS, "neutralized_value", "SELECT * FROM neu WHERE factor_name = 'VOLATILITY_20D'", neutral=True, digits=6)


def daily_neutral(m):
    rows = m.bars.select(F.col("trade_date").alias("signal_date"), "symbol", "float_market_cap", (F.col("adj_close") / F.col("adj_open") - 1).alias("raw_value"))
    return cross_section.neutralize(cross_section.require_context(asof.attach_interval(rows, m.industries, ["industry_code"])), hot=m.hot())


DAILY = {"pan": """SELECT b.trade_date AS signal_date, b.symbol, b.float_market_cap, adj_close / adj_open - 1 AS raw_value, industry_code, 'x' AS factor_name FROM bars b
  JOIN industries i ON i.symbol = b.symbol AND i.valid_from <= b.trade_date AND (i.valid_to IS NULL OR i.valid_to >= b.trade_date)"""}
query("X7_daily_neutral", daily_neutral, "signal_date symbol", "neutralized_value", ctes="bars industries", extra={**DAILY, **NEUTRAL}, sql="SELECT * FROM neu", digits=5)


def layered(m):
    rows = panel(m, ["MOMENTUM_60D"], neutral=True).where(F.col("raw_value").isNotNull())
    rows = rows.select("signal_date", "symbol", "industry_code", F.col("raw_value").alias("factor_value"), (F.col("float_market_cap") / 1e6).alias("benchmark_weight"))
    return cross_section.industry_layers(rows, hot=m.hot())


x("X8_industry_layers", layered, "signal_date symbol industry_code layer", "boundary_fraction target_weight",
  """SELECT signal_date, symbol, industry_code, layer, ov * n AS boundary_fraction, iw * ov * 5 AS target_weight FROM (SELECT *, least(r / n, layer / 5.0) - greatest((r - 1) / n, (layer - 1) / 5.0) AS ov FROM l1, range(1, 6) t(layer)) WHERE ov > 1e-12""",
  {"l1": """SELECT signal_date, symbol, industry_code, row_number() OVER (PARTITION BY signal_date, industry_code ORDER BY raw_value DESC, symbol)::DOUBLE AS r, count(*) OVER g::DOUBLE AS n,
    sum(float_market_cap) OVER g / sum(float_market_cap) OVER (PARTITION BY signal_date) AS iw FROM pan WHERE factor_name = 'MOMENTUM_60D' AND raw_value IS NOT NULL WINDOW g AS (PARTITION BY signal_date, industry_code)"""}, digits=7)

# --- evaluation ---------------------------------------------------------------------
MONTHLY = {
    "vt": "SELECT signal_date, symbol, factor_name, 'raw' AS value_type, raw_value AS v0, forward_return AS f FROM neu UNION ALL SELECT signal_date, symbol, factor_name, 'neutralized', neutralized_value, forward_return FROM neu",
    "va": "SELECT *, 'original' AS orientation, v0 AS v FROM vt UNION ALL SELECT *, 'reversed', -v0 FROM vt",
    "tot": "SELECT signal_date, factor_name, value_type, orientation, count(*) AS total FROM va GROUP BY ALL",
    "s1": """SELECT *, rank() OVER (PARTITION BY signal_date, factor_name, value_type, orientation ORDER BY v) + (count(*) OVER (PARTITION BY signal_date, factor_name, value_type, orientation, v) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY signal_date, factor_name, value_type, orientation ORDER BY f) + (count(*) OVER (PARTITION BY signal_date, factor_name, value_type, orientation, f) - 1) / 2.0 AS ry,
      row_number() OVER (PARTITION BY signal_date, factor_name, value_type, orientation ORDER BY v, symbol) AS rf, count(*) OVER (PARTITION BY signal_date, factor_name, value_type, orientation) AS n
      FROM va WHERE v IS NOT NULL AND f IS NOT NULL""",
    "s2": "SELECT *, 6 - greatest(1, (5 * (rf - 1) + n - 2) // (n - 1)) AS q FROM s1 WHERE n >= 3",
    "tn": """SELECT *, (rank() OVER (PARTITION BY signal_date, factor_name, value_type, orientation ORDER BY v) + (count(*) OVER (PARTITION BY signal_date, factor_name, value_type, orientation, v) - 1) / 2.0)
      / count(*) OVER (PARTITION BY signal_date, factor_name, value_type, orientation) AS pr FROM va WHERE v IS NOT NULL""",
    "ds": "SELECT factor_name, signal_date, lag(signal_date) OVER (PARTITION BY factor_name ORDER BY signal_date) AS prev FROM (SELECT DISTINCT factor_name, signal_date FROM pan)",
    "to1": """SELECT a.signal_date, a.factor_name, a.value_type, a.orientation, avg(abs(a.pr - b.pr)) AS rank_turnover FROM tn a JOIN ds USING (factor_name, signal_date)
      JOIN tn b ON b.factor_name = a.factor_name AND b.signal_date = ds.prev AND b.symbol = a.symbol AND b.value_type = a.value_type AND b.orientation = a.orientation GROUP BY ALL""",
    "mon": """SELECT signal_date, factor_name, value_type, orientation, corr(rx, ry) AS rank_ic, regr_slope(f, rx) AS factor_return, max(n) / max(total)::DOUBLE AS coverage,
      avg(f) FILTER (q = 1) AS group_1, avg(f) FILTER (q = 2) AS group_2, avg(f) FILTER (q = 3) AS group_3, avg(f) FILTER (q = 4) AS group_4, avg(f) FILTER (q = 5) AS group_5, max(rank_turnover) AS rank_turnover,
      CASE WHEN signal_date <= DATE '1998-12-31' THEN 'development' WHEN signal_date <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS period
      FROM s2 JOIN tot USING (signal_date, factor_name, value_type, orientation) LEFT JOIN to1 USING (signal_date, factor_name, value_type, orientation) GROUP BY signal_date, factor_name, value_type, orientation""",
}
GROUPS = "group_1 group_2 group_3 group_4 group_5"
VARIANT = "factor_name value_type orientation"


def monthly(m):
    """Monthly statistics, stored: a few rows per factor and date, which summaries and portfolios read several times."""
    return cut(evaluate.monthly_statistics(panel(m, neutral=True), IDS, PERIODS, hot=m.hot(len(NAMES))))


def hac(source: str, keys: str, value: str, date: str = "signal_date") -> dict:
    """Autocovariances through a self join on row numbers: another route than arrays."""
    return {
        f"h0_{value}": f"SELECT {keys}, {value} AS xx, row_number() OVER (PARTITION BY {keys} ORDER BY {date}) AS i, count(*) OVER (PARTITION BY {keys}) AS n, avg({value}) OVER (PARTITION BY {keys}) AS mu FROM {source} WHERE {value} IS NOT NULL",
        f"h1_{value}": f"SELECT *, least(floor(4 * pow(n / 100.0, 2.0 / 9))::BIGINT, n - 1) AS lags FROM h0_{value}",
        f"h2_{value}": f"""SELECT {keys}, max(a.n) AS n, max(a.mu) AS mu, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.lags + 1.0)) END * (a.xx - a.mu) * (b.xx - b.mu)) / max(a.n) AS va
          FROM h1_{value} a JOIN h1_{value} b USING ({keys}) WHERE a.i - b.i BETWEEN 0 AND a.lags GROUP BY ALL""",
        f"hac_{value}": f"SELECT {keys}, CASE WHEN n >= 3 THEN mu / nullif(sqrt(greatest(va, 0) / n), 0) END AS t FROM h2_{value}",
    }


P_VALUE = "(CASE WHEN {0} IS NULL THEN NULL WHEN {0} = 0 THEN 1 WHEN abs({0}) > 9 THEN 0 ELSE 1 - exp(-{0} * {0} / 2) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({0}) / sqrt(2)) - lgamma(k + 1.5)))) END)"
x("X9_monthly_statistics", monthly, "signal_date factor_name value_type orientation", f"rank_ic factor_return coverage {GROUPS} rank_turnover", "SELECT * FROM mon", MONTHLY, neutral=True, digits=7)
x("X10_quintile", lambda m: groups.ranks(panel(m, ["REVERSAL_5D"]), PF, "raw_value", ["symbol"], first="r", count="n", hot=m.hot()).where("n >= 3").select("signal_date", "symbol", groups.quintile("r", "n").alias("q")), "signal_date symbol", "q",
  """SELECT signal_date, symbol, CASE WHEN raw_value IS NOT NULL THEN 6 - greatest(1, (5 * (row_number() OVER (PARTITION BY signal_date ORDER BY raw_value NULLS LAST, symbol) - 1) + count(raw_value) OVER p - 2) // (count(raw_value) OVER p - 1)) END AS q
    FROM pan WHERE factor_name = 'REVERSAL_5D' WINDOW p AS (PARTITION BY signal_date) QUALIFY count(raw_value) OVER p >= 3""", ints="q")


def index_series(m):
    return asof.market_returns(m.index_daily).where(F.col("market_return").isNotNull()).select(F.year("trade_date").alias("y"), F.col("trade_date").alias("signal_date"), "market_return")


YEARS = {"ix": "SELECT trade_date, avg(adj_close) AS cl FROM bars GROUP BY trade_date", "ir": "SELECT * FROM (SELECT trade_date AS signal_date, year(trade_date) AS y, cl / lag(cl) OVER (ORDER BY trade_date) - 1 AS r FROM ix) WHERE r IS NOT NULL"}
query("X11_newey_west", lambda m: add_hac_t(index_series(m).groupBy("y").agg(evaluate._series("market_return").alias("s")), "s", "t"), "y", "t", ctes="bars", extra={**YEARS, **hac("ir", "y", "r")}, sql="SELECT y, t FROM hac_r")
SUMMARY = {
    "bo": "SELECT * EXCLUDE (period), 'all' AS period FROM mon UNION ALL SELECT * EXCLUDE (period), period FROM mon",
    **hac("bo", "factor_name, value_type, orientation, period", "rank_ic"),
    **hac("bo", "factor_name, value_type, orientation, period", "factor_return"),
    "g5": "SELECT factor_name, value_type, orientation, unnest([1, 2, 3, 4, 5]) AS k, unnest(gs) AS g FROM (SELECT factor_name, value_type, orientation, [avg(group_1), avg(group_2), avg(group_3), avg(group_4), avg(group_5)] AS gs FROM mon GROUP BY 1, 2, 3)",
    "mono": "SELECT factor_name, value_type, orientation, 'all' AS period, -corr(k, gr) AS monotonicity FROM (SELECT *, rank() OVER (PARTITION BY factor_name, value_type, orientation ORDER BY g) AS gr FROM g5) GROUP BY ALL",
    "summ": """SELECT factor_name, value_type, orientation, period, avg(rank_ic) AS rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS icir, max(a.t) AS hac_t, avg(factor_return) AS fama_macbeth_return, max(b.t) AS fama_macbeth_hac_t,
      avg(coverage) AS coverage, max(monotonicity) AS monotonicity FROM bo LEFT JOIN hac_rank_ic a USING (factor_name, value_type, orientation, period) LEFT JOIN hac_factor_return b USING (factor_name, value_type, orientation, period)
      LEFT JOIN mono USING (factor_name, value_type, orientation, period) GROUP BY factor_name, value_type, orientation, period""",
    "pv": f"SELECT *, {P_VALUE.format('hac_t')} AS p_value FROM summ",
    "bh": """SELECT *, least(1, min(p_value * tests / rk) OVER (ORDER BY rk DESC)) AS bh_q_value FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS tests FROM pv WHERE p_value IS NOT NULL)""",
}
SVALUES = "rank_ic icir hac_t fama_macbeth_return fama_macbeth_hac_t coverage monotonicity"
x("X12_summary", lambda m: evaluate.summary_statistics(monthly(m)), f"{VARIANT} period", SVALUES, "SELECT * FROM summ", {**MONTHLY, **SUMMARY}, neutral=True, digits=6)
x("X13_rank_turnover", lambda m: evaluate.rank_turnover(panel(m), "raw_value", hot=m.hot()), "signal_date factor_name", "original reversed",
  "SELECT d.signal_date, d.factor_name, max(rank_turnover) FILTER (orientation = 'original') AS original, max(rank_turnover) FILTER (orientation = 'reversed') AS reversed FROM ds d LEFT JOIN to1 t ON t.signal_date = d.signal_date AND t.factor_name = d.factor_name AND value_type = 'raw' GROUP BY ALL", MONTHLY, neutral=True)
query("X14_benjamini_hochberg", lambda m: benjamini_hochberg(m.table("orders").groupBy("o_custkey").agg((F.abs(F.sin(F.sum("o_totalprice"))) / 10).alias("p")), "p", "q", ties=["o_custkey"], hot=True), "o_custkey", "p q",
      extra={"ps": "SELECT o_custkey, abs(sin(sum(o_totalprice))) / 10 AS p FROM orders GROUP BY 1", "rk": "SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM ps"},
      sql="SELECT o_custkey, p, least(1, min(p * n / k) OVER (ORDER BY k DESC)) AS q FROM rk", digits=5)
x("X15_evaluate_batch", lambda m: evaluate.evaluate_batch(panel(m, neutral=True), PERIODS, hot=m.hot(len(NAMES)))[1], f"{VARIANT} period", "rank_ic hac_t p_value bh_q_value", "SELECT * FROM bh", {**MONTHLY, **SUMMARY}, neutral=True, digits=6)


def member_panel(m, names):
    m = m.stored()
    return cut(panels.labelled_members(m, names, m.marked_forward))


X16 = ["REVERSAL_5D", "TURNOVER_MEAN_5D"]


def member_sql(names) -> dict:
    """CTEs that end in ``pan``: the standardised, labelled panel of index members for some factors."""
    listed = ", ".join(f"'{n}'" for n in names)
    return {
        **bar_sql(list(names))["extra"], "mm": MEMBER_LABEL.replace("LEFT JOIN forward f", "LEFT JOIN mforward f"),
        "el": f"""SELECT mm.*, {', '.join(f'fac.{n}' for n in names)} FROM mm JOIN fac ON fac.symbol = mm.symbol AND fac.trade_date = mm.signal_date JOIN status t ON t.symbol = mm.symbol AND t.trade_date = mm.signal_date
          JOIN securities q ON q.symbol = mm.symbol WHERE NOT is_st AND NOT is_suspended AND (SELECT count(*) FROM cal WHERE cal.trade_date >= q.list_date AND cal.trade_date <= mm.signal_date) >= 250""",
        "lo": f"SELECT signal_date, symbol, forward_return, unnest([{listed}]) AS factor_name, unnest([{', '.join(names)}]) AS v FROM el",
        "m1": "SELECT *, median(v) OVER p AS md FROM lo WINDOW p AS (PARTITION BY signal_date, factor_name)",
        "m2": "SELECT *, median(abs(v - md)) OVER p AS mad FROM m1 WINDOW p AS (PARTITION BY signal_date, factor_name)",
        "m3": "SELECT *, CASE WHEN coalesce(mad, 0) = 0 THEN v ELSE greatest(md - 5 * mad, least(md + 5 * mad, v)) END AS wv FROM m2",
        "pan": "SELECT *, (wv - avg(wv) OVER p) / nullif(stddev_pop(wv) OVER p, 0) AS raw_value FROM m3 WINDOW p AS (PARTITION BY signal_date, factor_name)",
    }


MEMBER_CTES = "rt signals members mforward securities status cal"
query("X16_evaluate_indices", lambda m: evaluate.evaluate_indices(member_panel(m, X16).select("signal_date", "symbol", "index_code", "factor_name", "raw_value", "forward_return"), PERIODS, ["raw"], m.hot(2))[1],
      f"index_code {VARIANT} period", "rank_ic hac_t p_value bh_q_value development_selection_q_value", ctes=MEMBER_CTES, digits=6,
      extra={**member_sql(X16), **MONTHLY, "vt": "SELECT signal_date, symbol, factor_name, 'raw' AS value_type, raw_value AS v0, forward_return AS f FROM pan", **SUMMARY,
             "de": "SELECT factor_name, value_type, orientation, period, least(1, min(p_value * tests / rk) OVER (ORDER BY rk DESC)) AS development_selection_q_value FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS tests FROM pv WHERE p_value IS NOT NULL AND period = 'development' AND orientation = 'original')"},
      sql=f"SELECT '{INDEX_CODE}' AS index_code, pv.*, bh_q_value, development_selection_q_value FROM pv LEFT JOIN (SELECT factor_name, value_type, orientation, period, bh_q_value FROM bh) USING (factor_name, value_type, orientation, period) LEFT JOIN de USING (factor_name, value_type, orientation, period)")
query("X17_merged_panel_evaluation", lambda m: evaluate.summary_statistics(evaluate.monthly_statistics(
      panels.without_repeats(panel(m, NAMES[:2]), panel(m, NAMES[1:3])), IDS, PERIODS, ["raw"], m.hot(3), turnover=False)), f"{VARIANT} period", "rank_ic icir coverage",
      ctes=CTES, extra={**PANEL, **NEUTRAL, **MONTHLY, **SUMMARY}, sql="SELECT * FROM summ WHERE value_type = 'raw' AND factor_name <> 'AMIHUD_20D'", digits=6)
ICM = {"rk": """SELECT *, CASE WHEN raw_value IS NOT NULL THEN rank() OVER (PARTITION BY signal_date, factor_name ORDER BY raw_value NULLS LAST) + (count(raw_value) OVER (PARTITION BY signal_date, factor_name, raw_value) - 1) / 2.0 END AS rx,
  CASE WHEN forward_return IS NOT NULL THEN rank() OVER (PARTITION BY signal_date, factor_name ORDER BY forward_return NULLS LAST) + (count(forward_return) OVER (PARTITION BY signal_date, factor_name, forward_return) - 1) / 2.0 END AS ry FROM pan""",
  "rm": "SELECT *, avg(rx) OVER p AS mx, avg(ry) OVER p AS my FROM rk WINDOW p AS (PARTITION BY signal_date, factor_name)",
  "icm": "SELECT signal_date, factor_name, CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END AS rank_ic, sum((rx - mx) * (ry - my)) / nullif(sum((rx - mx) * (rx - mx)), 0) AS factor_return FROM rm GROUP BY 1, 2"}
x("X18_ic_matrix", lambda m: evaluate.ic_matrix(panel(m), hot=m.hot()), "signal_date factor_name", "rank_ic factor_return", "SELECT * FROM icm", ICM)
WIDE = {"wide": "PIVOT pan ON factor_name USING first(raw_value) GROUP BY signal_date, symbol"}


def wide(m, names=NAMES):
    return panel(m, names).groupBy("signal_date", "symbol").pivot("factor_name", names).agg(F.first("raw_value"))


x("X4_wide_zscores", lambda m: (lambda w: cross_section.zscore(cross_section.zscore(w, ["signal_date"], "MOMENTUM_60D", "z1", hot=m.hot()), ["signal_date"], "VOLATILITY_20D", "z2", hot=m.hot()))(wide(m)), "signal_date symbol", "z1 z2",
  """SELECT signal_date, symbol, (a - avg(a) OVER p) / nullif(stddev_pop(a) OVER p, 0) AS z1, (b - avg(b) OVER p) / nullif(stddev_pop(b) OVER p, 0) AS z2 FROM wd WINDOW p AS (PARTITION BY signal_date)""",
  {"wd": "SELECT signal_date, symbol, max(raw_value) FILTER (factor_name = 'MOMENTUM_60D') AS a, max(raw_value) FILTER (factor_name = 'VOLATILITY_20D') AS b FROM pan GROUP BY 1, 2"})
CORR = {"pairs": "SELECT a.signal_date, a.factor_name AS l, b.factor_name AS r, count(*) AS pairs, CASE WHEN isfinite(corr(a.rx, b.rx)) THEN corr(a.rx, b.rx) END AS c FROM rk a JOIN rk b ON a.signal_date = b.signal_date AND a.symbol = b.symbol AND a.rx IS NOT NULL AND b.rx IS NOT NULL GROUP BY ALL"}
ORDERED = " AND ".join(["list_position(['" + "', '".join(NAMES) + "'], l) <= list_position(['" + "', '".join(NAMES) + "'], r)"])
x("X19_mean_correlation", lambda m: evaluate.mean_correlation(evaluate.panel_correlation(panel(m), NAMES, "raw_value", hot=m.hot(len(NAMES)))).withColumnsRenamed({"left": "factor_a", "right": "factor_b"}), "factor_a factor_b", "correlation",
  f"SELECT l AS factor_a, r AS factor_b, avg(c) AS correlation FROM pairs WHERE {ORDERED} GROUP BY ALL", {**ICM, **CORR})
x("X20_selection_correlation", lambda m: evaluate.mean_correlation(evaluate.panel_correlation(panel(m), NAMES, "raw_value", hot=m.hot(len(NAMES))), 10, m.month_ends.where("signal_date BETWEEN DATE'1998-01-01' AND DATE'1999-12-31'")).withColumnsRenamed({"left": "factor_a", "right": "factor_b"}),
  "factor_a factor_b", "correlation", f"SELECT l AS factor_a, r AS factor_b, avg(CASE WHEN pairs >= 10 THEN c END) AS correlation FROM pairs WHERE signal_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND {ORDERED} GROUP BY ALL", {**ICM, **CORR})

# --- performance ------------------------------------------------------------------------
LONG = {
    "pr": "SELECT factor_name, value_type, orientation, signal_date, period, (group_1 + group_2 + group_3 + group_4 + group_5) / 5 AS bench, unnest(['group_1', 'group_2', 'group_3', 'group_4', 'group_5', 'benchmark', 'long_short']) AS portfolio, unnest([group_1, group_2, group_3, group_4, group_5, (group_1 + group_2 + group_3 + group_4 + group_5) / 5, group_1 - group_5]) AS r FROM mon",
}


def perf_sql(source: str, keys: str, r: str = "r", baseline: bool = False) -> dict:
    peak = f"max(w) OVER (PARTITION BY {keys} ORDER BY signal_date)"
    return {
        "w0": f"SELECT *, product(1 + {r}) OVER (PARTITION BY {keys} ORDER BY signal_date) AS w FROM {source} WHERE {r} IS NOT NULL",
        "w1": f"SELECT *, w / {'greatest(1, ' + peak + ')' if baseline else peak} - 1 AS dd FROM w0",
        "w2": f"""SELECT {keys}, pow(product(1 + {r}), 12.0 / count(*)) - 1 AS annualized_return, stddev_samp({r}) * sqrt(12) AS annualized_volatility, stddev_samp(least({r}, 0)) * sqrt(12) AS ds,
          min(dd) AS max_drawdown, avg(({r} > 0)::INT) AS monthly_win_rate FROM w1 GROUP BY {keys}""",
        "perf": "SELECT *, annualized_return / nullif(annualized_volatility, 0) AS sharpe, annualized_return / nullif(ds, 0) AS sortino, annualized_return / nullif(abs(max_drawdown), 0) AS calmar FROM w2",
    }


def portfolios(m):
    return performance.portfolio_rows(monthly(m), ["factor_name", "value_type", "orientation", "period"])


PK = "factor_name value_type orientation portfolio"
PKC = ", ".join(PK.split())
x("X21_performance", lambda m: performance.performance(portfolios(m), PK.split(), "monthly_return"), PK, list(performance.METRICS), "SELECT * FROM perf", {**MONTHLY, **LONG, **perf_sql("pr", PKC)}, neutral=True, digits=6)
MET = {**perf_sql("pr", PKC),
       "q1": f"SELECT {PKC}, avg((g > 1)::INT) AS quarterly_win_rate FROM (SELECT {PKC}, date_trunc('quarter', signal_date) AS qq, product(1 + r) AS g FROM w0 GROUP BY ALL) GROUP BY {PKC}",
       "y1": f"SELECT {PKC}, avg((g > 1)::INT) AS yearly_win_rate FROM (SELECT {PKC}, date_trunc('year', signal_date) AS qq, product(1 + r) AS g FROM w0 GROUP BY ALL) GROUP BY {PKC}",
       "t5": f"SELECT {PKC}, sum(greatest(r, 0)) FILTER (k <= 5) / nullif(sum(greatest(r, 0)), 0) AS best_5_month_concentration FROM (SELECT *, row_number() OVER (PARTITION BY {PKC} ORDER BY r DESC) AS k FROM w0) GROUP BY {PKC}",
       "m0": f"SELECT {PKC}, avg(r) * 12 AS mu, stddev_samp(r) * sqrt(12) AS vol, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(12) AS dn FROM w0 GROUP BY {PKC}"}
x("X22_layer_metrics", lambda m: performance.layer_performance_metrics(portfolios(m), PK.split(), "monthly_return"), PK, list(performance.LAYER_METRICS),
  f"SELECT *, annualized_return AS annual_return, annualized_volatility AS annual_volatility, mu / nullif(vol, 0) AS sharpe2, mu / nullif(dn, 0) AS sortino2 FROM perf JOIN q1 USING ({PKC}) JOIN y1 USING ({PKC}) JOIN t5 USING ({PKC}) JOIN m0 USING ({PKC})".replace("SELECT *,", "SELECT * EXCLUDE (sharpe, sortino),").replace("sharpe2", "sharpe").replace("sortino2", "sortino"),
  {**MONTHLY, **LONG, **MET}, neutral=True, digits=6)
REL = {"rr": "SELECT *, r AS p, bench AS b, (1 + r) / (1 + bench) - 1 AS a FROM pr WHERE r IS NOT NULL AND bench IS NOT NULL",
       "r1": f"SELECT *, product(1 + p) OVER o AS pn, product(1 + b) OVER o AS bn FROM rr WINDOW o AS (PARTITION BY {PKC} ORDER BY signal_date)",
       "r2": f"SELECT *, pn / greatest(1, max(pn) OVER o) - 1 AS d1, (pn / bn) / greatest(1, max(pn / bn) OVER o) - 1 AS d2 FROM r1 WINDOW o AS (PARTITION BY {PKC} ORDER BY signal_date)"}
x("X23_relative_performance", lambda m: performance.relative_performance(portfolios(m).where("portfolio <> 'benchmark'"), PK.split(), "monthly_return", "__bench", 12.0), PK, list(performance.RELATIVE_METRICS),
  f"""SELECT {PKC}, count(*) AS periods, pow(product(1 + p), 12.0 / count(*)) - 1 AS annualized_return, pow(product(1 + b), 12.0 / count(*)) - 1 AS benchmark_annualized_return, pow(product(1 + a), 12.0 / count(*)) - 1 AS annualized_excess_return,
    avg(a) * 12 / nullif(stddev_samp(a) * sqrt(12), 0) AS information_ratio, avg(p) * 12 / nullif(stddev_samp(p) * sqrt(12), 0) AS sharpe_zero_rate, least(0, min(d1)) AS max_drawdown, least(0, min(d2)) AS relative_max_drawdown, avg((a > 0)::INT) AS active_win_rate
    FROM r2 WHERE portfolio <> 'benchmark' GROUP BY {PKC}""", {**MONTHLY, **LONG, **REL}, neutral=True, ints="periods", digits=6)
x("X24_short_statistics", lambda m: performance.performance(monthly(m), VARIANT.split(), "group_1").select(*VARIANT.split(), "annualized_return", "annualized_volatility", "sharpe", "max_drawdown"), VARIANT,
  "annualized_return annualized_volatility sharpe max_drawdown", "SELECT * FROM perf WHERE portfolio = 'group_1'", {**MONTHLY, **LONG, **perf_sql("pr", PKC)}, neutral=True, digits=6)
LAYER = {"pp": "SELECT *, period AS ph FROM pr UNION ALL SELECT *, 'all' AS ph FROM pr", **perf_sql("pp", PKC + ", ph"),
         "ex": f"""SELECT {PKC}, ph, CASE WHEN portfolio NOT IN ('benchmark', 'long_short') THEN pow(product(1 + r), 12.0 / count(*)) - pow(product(1 + bench), 12.0 / count(*)) END AS annualized_excess_return,
           CASE WHEN portfolio NOT IN ('benchmark', 'long_short') THEN avg(r - bench) * 12 / nullif(stddev_samp(r - bench) * sqrt(12), 0) END AS information_ratio FROM pp WHERE r IS NOT NULL GROUP BY {PKC}, ph"""}
x("X25_layer_performance", lambda m: performance.layered_performance(monthly(m), VARIANT.split()), f"{PK} period", "annualized_return sharpe max_drawdown annualized_excess_return information_ratio",
  f"SELECT *, ph AS period FROM perf JOIN ex USING ({PKC}, ph)", {**MONTHLY, **LONG, **LAYER}, neutral=True, digits=6)
x("X26_layered_nav", lambda m: performance.layered_nav(monthly(m), VARIANT.split()), f"signal_date {PK}", "monthly_return net_value",
  f"""SELECT signal_date, {PKC}, r AS monthly_return, w AS net_value FROM w0 UNION ALL SELECT (date_trunc('month', min(signal_date)) - INTERVAL 1 DAY)::DATE, {PKC}, NULL, 1.0 FROM pr GROUP BY {PKC}""", {**MONTHLY, **LONG, **perf_sql("pr", PKC)}, neutral=True, digits=7)
COST = {"cn": "SELECT *, group_1 - coalesce(rank_turnover, 0) * bps / 10000 AS r, coalesce(rank_turnover, 0) AS tv FROM (SELECT *, unnest(['base_5bps', 'stress_10bps']) AS cost_scenario, unnest([5.0, 10.0]) AS bps FROM bo)", **perf_sql("cn", "factor_name, value_type, orientation, period, cost_scenario"),
        "tv": "SELECT factor_name, value_type, orientation, period, cost_scenario, avg(tv) AS mean_turnover FROM cn GROUP BY ALL"}
COST_ROWS = "SELECT * FROM (SELECT factor_name, value_type, orientation, period, cost_scenario, annualized_return, annualized_volatility, sharpe, sortino, max_drawdown, calmar, monthly_win_rate::DOUBLE AS monthly_win_rate, mean_turnover FROM perf JOIN tv USING (factor_name, value_type, orientation, period, cost_scenario)) UNPIVOT INCLUDE NULLS (metric_value FOR metric_name IN (annualized_return, annualized_volatility, sharpe, sortino, max_drawdown, calmar, monthly_win_rate, mean_turnover))"
x("X27_cost_metrics", lambda m: performance.cost_metrics(monthly(m), VARIANT.split()), f"{VARIANT} period cost_scenario metric_name", "metric_value",
  COST_ROWS,
  {**MONTHLY, "bo": SUMMARY["bo"], **COST}, neutral=True, digits=6)
x("X28_metric_rows", lambda m: performance.metric_rows(evaluate.summary_statistics(monthly(m)).select(*VARIANT.split(), "period", "rank_ic", "icir", "coverage"), [*VARIANT.split(), "period"]), f"{VARIANT} period metric_name", "metric_value",
  "SELECT * FROM (SELECT factor_name, value_type, orientation, period, rank_ic, icir, coverage FROM summ) UNPIVOT INCLUDE NULLS (metric_value FOR metric_name IN (rank_ic, icir, coverage))", {**MONTHLY, **SUMMARY}, neutral=True, digits=6)
x("X29_group_order", lambda m: performance.period_samples(performance.descending_groups(monthly(m).drop("group_order"))).groupBy(*VARIANT.split(), "period").agg(F.avg("group_1").alias("g1"), F.avg("group_5").alias("g5")), f"{VARIANT} period", "g1 g5",
  "SELECT factor_name, value_type, orientation, period, avg(group_5) AS g1, avg(group_1) AS g5 FROM bo GROUP BY ALL", {**MONTHLY, "bo": SUMMARY["bo"]}, neutral=True)
query("X30_member_coverage", lambda m: performance.member_coverage(m.member_rows), "index_code", "mean_members min_members max_members", ints="min_members max_members", ctes="members signals",
      sql="""SELECT index_code, avg(n) AS mean_members, min(n) AS min_members, max(n) AS max_members FROM (SELECT index_code, s.signal_date, count(DISTINCT symbol) AS n FROM members JOIN signals s
        ON s.signal_date >= valid_from AND (valid_to IS NULL OR s.signal_date <= valid_to) GROUP BY 1, 2) GROUP BY 1""")
x("X31_metric_table", lambda m: performance.metric_table(performance.metric_rows(evaluate.summary_statistics(monthly(m)).where("value_type = 'raw' AND orientation = 'original'").select("factor_name", "period", "rank_ic", "icir"), ["factor_name", "period"]), ["factor_name", "period"], ["rank_ic", "icir"]),
  "factor_name period", "rank_ic icir", "SELECT * FROM summ WHERE value_type = 'raw' AND orientation = 'original'", {**MONTHLY, **SUMMARY}, neutral=True, digits=6)
x("X32_nested_metrics", lambda m: performance.nested_metrics(performance.metric_rows(evaluate.summary_statistics(monthly(m)).select(*VARIANT.split(), "period", "rank_ic", "coverage"), [*VARIANT.split(), "period"]), "factor_name", ["value_type", "orientation", "period"]).select("factor_name", F.size("metrics").alias("n")),
  "factor_name", "n", "SELECT factor_name, 2 * count(*) AS n FROM summ GROUP BY 1", {**MONTHLY, **SUMMARY}, neutral=True, ints="n")
x("X33_family_counts", lambda m: performance.family_counts(panel(m).select("factor_name", "signal_date").distinct().withColumn("family", F.when(F.col("factor_name").like("AMIHUD%"), "liquidity").when(F.col("factor_name").like("%VOL%"), "risk").otherwise("momentum"))), "family", "factors",
  "SELECT CASE WHEN factor_name LIKE 'AMIHUD%' THEN 'liquidity' WHEN factor_name LIKE '%VOL%' THEN 'risk' ELSE 'momentum' END AS family, count(DISTINCT (factor_name, signal_date)) AS factors FROM pan GROUP BY 1", ints="factors")
x("X34_monotonicity", lambda m: monthly(m).groupBy(*VARIANT.split()).agg(evaluate.monotonicity([F.avg(g) for g in evaluate.GROUPS]).alias("monotonicity")), VARIANT, "monotonicity", "SELECT * FROM mono", {**MONTHLY, "g5": SUMMARY["g5"], "mono": SUMMARY["mono"]}, neutral=True)
query("X35_dividend_summary", lambda m: __import__("quantloom.sources.vendor", fromlist=["x"]).dividend_summary(m.events), "first_date last_date", "events symbols lowest_factor highest_factor", ints="events symbols", ctes="events_adj",
      sql="SELECT count(*) AS events, count(DISTINCT symbol) AS symbols, min(trade_date) AS first_date, max(trade_date) AS last_date, min(factor) AS lowest_factor, max(factor) AS highest_factor FROM events_adj")
x("X36_nav_series", lambda m: performance.nav_series(performance.layered_nav(monthly(m), VARIANT.split()), VARIANT.split()).select(*PK.split(), F.size("points").alias("n"), F.element_at("points", -1)["net_value"].alias("last_value")), PK, "n last_value",
  f"SELECT {PKC}, count(*) + 1 AS n, product(1 + r) AS last_value FROM pr WHERE r IS NOT NULL GROUP BY {PKC}", {**MONTHLY, **LONG}, neutral=True, ints="n", digits=7)
query("X37_metrics_of_runs", lambda m: performance.metrics_of_runs(m.table("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("metric_name"), F.col("o_totalprice").alias("metric_value")),
      m.table("customer").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("created_at"))).groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.sum("metric_value").alias("total")), "metric_name", "n total", ints="n",
      sql="SELECT o_orderpriority AS metric_name, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", digits=2)
query("X38_stale_dependencies", lambda m: performance.stale_dependencies(m.table("part").select("p_partkey", F.col("p_brand").alias("factor_id"), F.col("p_size").alias("locked_revision")),
      m.table("part").groupBy(F.col("p_brand").alias("factor_id")).agg(F.max("p_size").alias("current_revision"))), "p_partkey factor_id", "stale", ints="stale",
      sql="SELECT p_partkey, p_brand AS factor_id, CASE WHEN p_size = max(p_size) OVER (PARTITION BY p_brand) THEN 0 ELSE 1 END AS stale FROM part")
query("two_sided_p", lambda m: m.table("events").select("event_id", two_sided_p(F.col("value") / 20).alias("p")), "event_id", "p", extra={"e": "SELECT event_id, value / 20 AS t FROM events"}, sql=f"SELECT event_id, {P_VALUE.format('t')} AS p FROM e")
x("flagship_momentum", lambda m: evaluate.monthly_statistics(panel(m, ["MOMENTUM_60D"]), IDS, PERIODS, ["raw"], m.hot()).where("orientation = 'original'"), "signal_date factor_name period", f"rank_ic factor_return coverage {GROUPS}",
  "SELECT * FROM mon WHERE factor_name = 'MOMENTUM_60D' AND value_type = 'raw' AND orientation = 'original'", MONTHLY, neutral=True)
