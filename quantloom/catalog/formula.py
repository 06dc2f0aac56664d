"""Formula operators A1-A39."""

from pyspark.sql import functions as F

from quantloom.catalog.registry import query
from quantloom.catalog.sql import W, ema, over, roll
from quantloom.functions.scalar import clip, log, power, ratio
from quantloom.operators import formula, pit

KEY = "symbol trade_date"


def thin(m):
    """Bars whose turnover is missing on thin days, to exercise dropped observations."""
    return m.bars.withColumn("t", F.when(F.col("volume") > 5, F.col("turnover"))).select(
        "symbol", "trade_date", "t", "adj_close", "amount", "turnover"
    )


THIN = {"obs": "SELECT symbol, trade_date, turnover AS t FROM bars WHERE volume > 5"}


def observed(expr: str) -> dict:
    return {
        "sql": f"""SELECT b.symbol, b.trade_date, q.x FROM bars b ASOF LEFT JOIN (SELECT symbol, trade_date, {expr} AS x FROM obs) q
          ON b.symbol = q.symbol AND b.trade_date >= q.trade_date""",
        "ctes": "bars",
        "extra": THIN,
    }


query("A1_asof_at_month_ends", lambda m: pit.latest_on_dates(m.bars, m.month_ends, ["adj_close", "turnover"]),
      "signal_date symbol", "adj_close turnover", ctes="bars signals",
      sql="""SELECT s.signal_date, s.symbol, b.adj_close, b.turnover FROM (SELECT signal_date, symbol FROM signals, (SELECT DISTINCT symbol FROM bars)) s
        ASOF JOIN bars b ON b.symbol = s.symbol AND s.signal_date >= b.trade_date""")
query("A9_rolling_mean", lambda m: formula.rolling_mean(thin(m), "t", 20, "x"), KEY, "x", **observed(roll("t", 20, 16)))
query("A10_std", lambda m: formula.std(thin(m), "t", 20, "x"), KEY, "x", **observed(roll("t", 20, 16, "stddev_samp")))
query("A11_sum", lambda m: formula.total(thin(m), "t", 10, "x", minimum=4), KEY, "x", **observed(roll("t", 10, 4, "sum")))
query("A12_min", lambda m: formula.low(thin(m), "t", 15, "x"), KEY, "x", **observed(roll("t", 15, 12, "min")))
query("A13_max", lambda m: formula.high(thin(m), "t", 15, "x"), KEY, "x", **observed(roll("t", 15, 12, "max")))
query("A7_return_skip", lambda m: formula.returns(thin(m), "t", 10, "x", skip=3), KEY, "x",
      **observed(f"lag(t, 3) OVER ({W}) / nullif(lag(t, 13) OVER ({W}), 0) - 1"))
query("A8_diff", lambda m: formula.diff(thin(m), "t", "x", periods=2), KEY, "x", **observed(f"t - lag(t, 2) OVER ({W})"))
query("A14_ewm", lambda m: formula.ewm(thin(m), "t", 12, "x"), KEY, "x", ctes="bars",
      extra={"obs": f"SELECT symbol, trade_date, row_number() OVER ({W}) AS i, turnover AS t FROM bars WHERE volume > 5",
             "ob2": ema("obs", "t", "x", 2 / 13, 12)},
      sql="""SELECT b.symbol, b.trade_date, q.x FROM bars b ASOF LEFT JOIN ob2 q ON b.symbol = q.symbol AND b.trade_date >= q.trade_date""")
query("A15_safe_div", lambda m: m.daily.select("symbol", "trade_date", ratio("amount", F.col("volume") - 1).alias("x")), KEY, "x",
      ctes="daily", sql="SELECT symbol, trade_date, amount / nullif(volume - 1, 0) AS x FROM daily")
query("A16_log", lambda m: m.daily.select("symbol", "trade_date", log(F.col("volume") - 5).alias("x")), KEY, "x",
      ctes="daily", sql="SELECT symbol, trade_date, CASE WHEN volume > 5 THEN ln(volume - 5) END AS x FROM daily")
query("A17_abs", lambda m: m.bars.select("symbol", "trade_date", F.abs(F.col("close") - F.col("adj_close")).alias("x")), KEY, "x",
      ctes="bars", sql="SELECT symbol, trade_date, abs(close - adj_close) AS x FROM bars", digits=6)
query("A18_clip", lambda m: thin(m).select("symbol", "trade_date", clip("t", 0.01, 0.03).alias("x")), KEY, "x",
      ctes="bars", sql="SELECT symbol, trade_date, CASE WHEN volume > 5 THEN greatest(0.01, least(0.03, turnover)) END AS x FROM bars")
query("A19_rank_pct", lambda m: formula.rank(thin(m), "t", "x", hot=m.hot()), KEY, "x", ctes="bars",
      sql="""SELECT symbol, trade_date, CASE WHEN t IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY t NULLS LAST)
        + (count(t) OVER (PARTITION BY trade_date, t) - 1) / 2.0) / count(t) OVER (PARTITION BY trade_date) END AS x
        FROM (SELECT *, CASE WHEN volume > 5 THEN turnover END AS t FROM bars)""")
query("A20_zscore", lambda m: formula.zscore(thin(m), "t", "x", hot=m.hot()), KEY, "x", ctes="bars",
      sql="""SELECT symbol, trade_date, (t - avg(t) OVER d) / nullif(stddev_pop(t) OVER d, 0) AS x
        FROM (SELECT *, CASE WHEN volume > 5 THEN turnover END AS t FROM bars) WINDOW d AS (PARTITION BY trade_date)""")
query("A21_winsorize", lambda m: formula.winsorize(m.bars, "volume", "x", scale=1.0, hot=m.hot()), KEY, "x", ctes="bars",
      sql="""SELECT symbol, trade_date, CASE WHEN mad = 0 THEN volume ELSE greatest(md - mad, least(md + mad, volume)) END AS x FROM (
        SELECT *, median(abs(volume - md)) OVER (PARTITION BY trade_date) AS mad FROM (
        SELECT *, median(volume) OVER (PARTITION BY trade_date) AS md FROM bars))""")
query("A22_features", lambda m: m.bars.select("symbol", "trade_date", F.element_at(formula.features("adj_close", "turnover"), 1).alias("first"),
      F.size(formula.features("adj_close", "turnover")).alias("n")), KEY, "first n", ints="n", ctes="bars", digits=6,
      sql="SELECT symbol, trade_date, adj_close AS first, 2 AS n FROM bars")
query("A24_ensemble", lambda m: thin(m).select("symbol", "trade_date", formula.ensemble(["t", "turnover"], [1.0, 3.0]).alias("x")), KEY, "x",
      ctes="bars", sql="SELECT symbol, trade_date, CASE WHEN volume > 5 THEN turnover * 0.25 + turnover * 0.75 END AS x FROM bars")
query("A28_turnover_bias", lambda m: formula.turnover_bias(thin(m), "t", 20, 120, "x"), KEY, "x",
      **observed(f"CASE WHEN count(t) {over(120)} >= 96 THEN avg(t) {over(20)} / nullif(avg(t) {over(120)}, 0) - 1 END"))
query("A29_amihud", lambda m: formula.amihud(m.bars, "adj_close", "amount", 20, "x", minimum=15), KEY, "x", ctes="rt",
      extra={"il": "SELECT *, abs(r) / nullif(amount, 0) AS a FROM rt"},
      sql=f"SELECT symbol, trade_date, {roll('a', 20, 15)} * 1e8 AS x FROM il", digits=6)
query("A30_high_proximity", lambda m: formula.high_proximity(m.bars, "adj_close", 60, "x"), KEY, "x", ctes="tb",
      sql=f"SELECT symbol, trade_date, c / {roll('c', 60, 48, 'max')} - 1 AS x FROM tb")
query("A31_volatility", lambda m: formula.volatility(m.bars, "adj_close", 20, "x"), KEY, "x", ctes="rt",
      sql=f"SELECT symbol, trade_date, {roll('r', 20, 16, 'stddev_samp')} AS x FROM rt")
query("A32_upside_vol", lambda m: formula.upside_vol(m.bars, "adj_close", 20, "x"), KEY, "x", ctes="rt",
      extra={"up": "SELECT *, CASE WHEN r < 0 THEN 0.0 ELSE r END AS u FROM rt"},
      sql=f"SELECT symbol, trade_date, {roll('u', 20, 16, 'stddev_samp')} AS x FROM up")
query("A33_downside_vol", lambda m: formula.downside_vol(m.bars, "adj_close", 20, "x"), KEY, "x", ctes="rt",
      extra={"dn": "SELECT *, CASE WHEN r > 0 THEN 0.0 ELSE r END AS u FROM rt"},
      sql=f"SELECT symbol, trade_date, {roll('u', 20, 16, 'stddev_samp')} AS x FROM dn")
query("A34_max_return", lambda m: formula.max_return(m.bars, "adj_close", 20, "x"), KEY, "x", ctes="rt",
      sql=f"SELECT symbol, trade_date, {roll('r', 20, 16, 'max')} AS x FROM rt")
query("A35_abs_return", lambda m: formula.abs_return(m.bars, "adj_close", 1, "x"), KEY, "x", ctes="rt",
      sql="SELECT symbol, trade_date, abs(r) AS x FROM rt")

# Residuals are rebuilt from lists in SQL: a second way to the same numbers.
IDIO = {
    "mk": "SELECT trade_date, avg(r) AS mr FROM rt GROUP BY trade_date",
    "pairs": f"""SELECT symbol, trade_date, list(r) {over(60)} AS ys, list(mr) {over(60)} AS xs
      FROM rt JOIN mk USING (trade_date) WHERE r IS NOT NULL AND mr IS NOT NULL""",
    "mean2": "SELECT *, list_avg(ys) AS my, list_avg(xs) AS mx FROM pairs WHERE len(ys) >= 48",
    "beta": """SELECT *, list_sum(list_transform(list_zip(xs, ys), lambda p: (p[1] - mx) * (p[2] - my)))
      / nullif(list_sum(list_transform(xs, lambda x: (x - mx) * (x - mx))), 0) AS b FROM mean2""",
    "resid": """SELECT symbol, trade_date, list_transform(list_zip(xs, ys), lambda p: (p[2] - my) - b * (p[1] - mx)) AS e FROM beta""",
}
ALL_ROWS = """SELECT t.symbol, t.trade_date, q.x FROM tb t LEFT JOIN ({}) q ON t.symbol = q.symbol AND t.trade_date = q.trade_date"""


def idio(m, **kinds):
    return formula.idio(formula.market_mean_return(m.bars.select("symbol", "trade_date", "adj_close"), "adj_close"), "adj_close", 60, **kinds)


query("A36_idio_vol", lambda m: idio(m, vol="x"), KEY, "x", ctes="tb rt", extra=IDIO,
      sql=ALL_ROWS.format("SELECT symbol, trade_date, list_aggregate(e, 'stddev_samp') AS x FROM resid"))
query("A37_idio_skew", lambda m: idio(m, skew="x"), KEY, "x", ctes="tb rt", extra=IDIO,
      sql=ALL_ROWS.format("SELECT symbol, trade_date, list_aggregate(e, 'skewness') AS x FROM resid"))
query("A39_arithmetic",
      lambda m: m.bars.select("symbol", "trade_date", (-(F.col("adj_close") + 2 * F.col("open")) / 3 + power(F.col("turnover"), 2)).alias("x")),
      KEY, "x", ctes="bars", sql="SELECT symbol, trade_date, -(adj_close + 2 * open) / 3 + pow(turnover, 2) AS x FROM bars", digits=6)
