"""Selection O, weights and models M, portfolios B."""

from pyspark.sql import functions as F

from quantloom.catalog.evaluation import CTES, ICM, MONTHLY, NAMES, PANEL, VARIANT, labelled_rows, monthly, panel, x
from quantloom.catalog.registry import query
from quantloom.operators import asof, combine, evaluate, formula, models, performance, pit, portfolio, selection
from quantloom.plans import research
from quantloom.session import cut, stored
from quantloom.sources.market import INDEX_CODE, PERIODS

# --- selection ---------------------------------------------------------------------------


def parts(m):
    return m.table("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("factor_id"), F.col("p_brand").alias("family"), "p_partkey", "p_size", "p_retailprice")


def part_metrics(m):
    li = m.table("lineitem").withColumn("factor_id", F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    return li.groupBy("factor_id", F.when(F.col("l_returnflag") == "A", "IDX").otherwise("ALL_A").alias("index_code"), F.when(F.col("l_linestatus") == "F", "development").otherwise("validation").alias("period")).agg(
        F.round(F.avg("l_discount") - 0.05, 9).alias("metric_value")).withColumns({"metric_name": F.lit("rank_ic"), "orientation": F.lit("original")})


PM = {"pm": """SELECT 'P' || l_partkey AS factor_id, CASE WHEN l_returnflag = 'A' THEN 'IDX' ELSE 'ALL_A' END AS index_code, CASE WHEN l_linestatus = 'F' THEN 'development' ELSE 'validation' END AS period,
  round(avg(l_discount) - 0.05, 9) AS metric_value FROM lineitem GROUP BY ALL"""}
LOOK = {**PM, "lk": "SELECT factor_id, period, metric_value FROM pm WHERE index_code IN ('IDX', 'ALL_A') QUALIFY row_number() OVER (PARTITION BY factor_id, period ORDER BY index_code = 'IDX' DESC) = 1"}
query("O2_metric_lookup", lambda m: selection.metric_lookup(part_metrics(m), "IDX"), "factor_id period", "metric_value", extra=LOOK, sql="SELECT * FROM lk")
query("O1_resolve_factors", lambda m: selection.resolve(parts(m), part_metrics(m), families=["Brand#11", "Brand#12", "Brand#13"], rules=[{"metric": "rank_ic", "period": "development", "op": ">", "value": 0.0}],
      sort_by={"metric": "rank_ic", "period": "validation"}, top_n=15, direction="abs", include=["P7", "P8"], exclude=["P9"], index_code="IDX"), "factor_id family", extra=LOOK,
      sql="""SELECT 'P' || p_partkey AS factor_id, p_brand AS family FROM part WHERE p_partkey IN (7, 8) UNION SELECT factor_id, family FROM (
        SELECT f.factor_id, f.family, row_number() OVER (ORDER BY abs(v.metric_value) DESC NULLS LAST, f.factor_id) AS k FROM (SELECT 'P' || p_partkey AS factor_id, p_brand AS family FROM part) f
        JOIN lk d ON d.factor_id = f.factor_id AND d.period = 'development' AND d.metric_value > 0 LEFT JOIN lk v ON v.factor_id = f.factor_id AND v.period = 'validation'
        WHERE family IN ('Brand#11', 'Brand#12', 'Brand#13') AND f.factor_id NOT IN ('P7', 'P8', 'P9')) WHERE k <= 15""")


def runs(m):
    return m.table("orders").select(F.col("o_custkey").alias("factor_id"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"),
                                    F.date_sub("o_orderdate", 700).alias("run_start"), F.to_date("o_orderdate").alias("run_end"))


RUNS = {"ls": "SELECT o_custkey AS factor_id, o_orderkey AS run_id, o_orderdate::DATE AS created_at FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1"}
query("O3_latest_succeeded_runs", lambda m: selection.latest_succeeded_runs(runs(m)), "factor_id run_id created_at", extra=RUNS, sql="SELECT * FROM ls")
MOM = "SELECT * FROM pan WHERE factor_name = 'MOMENTUM_60D' AND raw_value IS NOT NULL"
x("O4_top_names", lambda m: selection.top_names(panel(m, ["MOMENTUM_60D"]).withColumnRenamed("raw_value", "score"), 10, reserve=0.005, hot=m.hot()), "signal_date symbol", "target_weight place",
  "SELECT *, 0.995 / count(*) OVER (PARTITION BY signal_date) AS target_weight FROM tn10", {"tn10": f"SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY raw_value DESC, symbol) AS place FROM ({MOM}) QUALIFY place <= 10"}, ints="place")


def part_summary(m):
    li = m.table("lineitem")
    return li.groupBy(F.col("l_returnflag").alias("index_code"), F.col("l_partkey").cast("string").alias("factor_name"), F.when(F.col("l_linestatus") == "F", "development").otherwise("validation").alias("period")).agg(
        F.round(F.avg("l_discount") - 0.05, 9).alias("rank_ic"), F.round(F.avg("l_tax") * 15, 9).alias("coverage"), F.round(F.avg("l_quantity") / 200, 9).alias("development_selection_q_value")).withColumns(
        {"value_type": F.lit("raw"), "orientation": F.lit("original")})


def part_directions(m):
    return m.table("part").select(F.col("p_partkey").cast("string").alias("factor_name"), F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("unknown")), (F.col("p_size") % 3 + 1).cast("int")).alias("direction"), F.col("p_type").alias("hypothesis"))


SUMM = {"sm": """SELECT l_returnflag AS index_code, l_partkey::VARCHAR AS factor_name, CASE WHEN l_linestatus = 'F' THEN 'development' ELSE 'validation' END AS period, round(avg(l_discount) - 0.05, 9) AS rank_ic,
  round(avg(l_tax) * 15, 9) AS coverage, round(avg(l_quantity) / 200, 9) AS q FROM lineitem GROUP BY ALL""",
  "sg": """SELECT DISTINCT a.index_code, a.factor_name, p_type AS hypothesis, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE CASE WHEN d.rank_ic < 0 THEN -1.0 ELSE 1.0 END END::DOUBLE AS sign FROM sm a JOIN part ON p_partkey::VARCHAR = a.factor_name
    LEFT JOIN sm d ON d.index_code = a.index_code AND d.factor_name = a.factor_name AND d.period = 'development'""",
  "sl": "SELECT index_code, factor_name, hypothesis, rank_ic * sign AS aligned_ic, coverage FROM sm JOIN sg USING (index_code, factor_name) WHERE period = 'development' AND rank_ic * sign > 0 AND coverage >= 0.5 AND q < 0.1"}
query("C15_locked_signs", lambda m: selection.locked_signs(part_summary(m), part_directions(m)), "index_code factor_name", "sign", extra=SUMM, sql="SELECT * FROM sg")
query("O5_development_factors", lambda m: selection.development_factors(part_summary(m), selection.locked_signs(part_summary(m), part_directions(m)), part_directions(m).select("factor_name", "hypothesis")), "index_code factor_name", "aligned_ic coverage",
      extra=SUMM, sql="SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY index_code, hypothesis ORDER BY aligned_ic DESC, coverage DESC, factor_name) = 1")


def kept_names(m):
    rows = panel(m)
    mean = evaluate.mean_correlation(evaluate.panel_correlation(rows, NAMES, "raw_value", hot=m.hot(len(NAMES))))
    priority = evaluate.ic_matrix(rows, hot=m.hot()).groupBy("factor_name").agg(F.avg("rank_ic").alias("priority"))
    kept = selection.low_correlation(mean, priority, NAMES, 0.3)
    return rows.select("factor_name").distinct().where(F.col("factor_name").isin(*kept))


query("O6_low_correlation", kept_names, "factor_name")
METHODS = {"mt": "SELECT c_mktsegment AS seg, 'n' || c_nationkey AS method, avg(c_acctbal) / 1e5 AS net_information_ratio, count(*)::DOUBLE AS turnover FROM customer GROUP BY ALL"}


def methods(m):
    return m.table("customer").groupBy(F.col("c_mktsegment").alias("seg"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("method")).agg((F.avg("c_acctbal") / 1e5).alias("net_information_ratio"), F.count(F.lit(1)).cast("double").alias("turnover"))


query("O7_validation_method", lambda m: selection.validation_method(methods(m), ["seg"], slack=0.02), "seg method", "turnover", extra=METHODS,
      sql="SELECT * FROM (SELECT *, max(net_information_ratio) OVER (PARTITION BY seg) AS b FROM mt) WHERE net_information_ratio >= b - 0.02 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY turnover, method) = 1")
query("O8_best_method", lambda m: selection.best_by(methods(m), ["seg"], "method", "net_information_ratio", "method"), "seg method", "net_information_ratio", extra=METHODS,
      sql="SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY seg ORDER BY net_information_ratio DESC, method) = 1")
x("O9_best_group", lambda m: selection.best_by(performance.performance(performance.portfolio_rows(monthly(m), VARIANT.split()).where(F.col("portfolio").startswith("group")), [*VARIANT.split(), "portfolio"], "monthly_return"),
  VARIANT.split(), "portfolio", "annualized_return", "portfolio"), f"{VARIANT} portfolio", "annualized_return",
  "SELECT factor_name, value_type, orientation, portfolio, pow(g, 12.0 / n) - 1 AS annualized_return FROM (SELECT factor_name, value_type, orientation, portfolio, product(1 + r) AS g, count(*) AS n FROM lr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY factor_name, value_type, orientation ORDER BY pow(g, 12.0 / n) DESC, portfolio) = 1",
  {**MONTHLY, "lr": "SELECT * FROM mon UNPIVOT (r FOR portfolio IN (group_1, group_2, group_3, group_4, group_5))"}, neutral=True, digits=6)
query("O10_consistent_factors", lambda m: selection.consistent_factors(part_summary(m)), "index_code factor_name", "weakest_ic place", ints="place", extra=SUMM,
      sql="""SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY weakest_ic DESC NULLS LAST, factor_name) AS place FROM (
        SELECT index_code, factor_name, CASE WHEN d IS NOT NULL AND v IS NOT NULL THEN least(d, v) END AS weakest_ic FROM (SELECT index_code, factor_name, max(rank_ic) FILTER (period = 'development') AS d, max(rank_ic) FILTER (period = 'validation') AS v
        FROM sm GROUP BY 1, 2)) QUALIFY place <= 10""")
query("O11_keyed_sample", lambda m: selection.keyed_sample(m.table("orders").select("o_orderkey"), 0.25, ["o_orderkey"]), "o_orderkey", ints="o_orderkey",
      sql="SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) < 1073741824")
query("O12_family_order", lambda m: selection.in_family_order(parts(m).withColumnRenamed("factor_id", "factor_name").withColumn("family", F.element_at(F.array(*[F.lit(f) for f in selection.FAMILY_ORDER]), (F.col("p_size") % 7 + 1).cast("int")))), "factor_name family", sql="SELECT 'P' || p_partkey AS factor_name, ['value', 'growth', 'momentum', 'liquidity', 'risk', 'quality', 'technical'][p_size % 7 + 1] AS family FROM part")
query("O13_family_leaders", lambda m: selection.family_leaders(part_summary(m).where("period = 'validation'").join(part_directions(m).select("factor_name", F.col("hypothesis").alias("family")), "factor_name"), 3), "index_code family factor_name", "rank_ic place", ints="place",
      extra=SUMM, sql="""SELECT * FROM (SELECT index_code, p_type AS family, factor_name, rank_ic, row_number() OVER (PARTITION BY index_code, p_type ORDER BY abs(rank_ic) DESC NULLS LAST, factor_name) AS place, count(*) OVER (PARTITION BY index_code, p_type) AS n
        FROM sm JOIN part ON p_partkey::VARCHAR = factor_name WHERE period = 'validation') WHERE n >= 2 AND place <= 3""")

# --- weights -----------------------------------------------------------------------------


def ic_history(m, column="rank_ic", until="1999-12-31"):
    rows = evaluate.ic_matrix(panel(m), hot=m.hot())
    return rows.where(F.col("signal_date") <= F.lit(until).cast("date")).select("signal_date", "factor_name", F.col(column).alias("value"))


HIST = {**ICM, "hi": "SELECT signal_date, factor_name, rank_ic AS value, factor_return AS fr FROM icm WHERE signal_date <= DATE '1999-12-31'",
        "ag": "SELECT *, dense_rank() OVER (ORDER BY signal_date DESC) - 1 AS age FROM hi QUALIFY age < 12",
        "me": "SELECT factor_name, sum(pow(0.5, age / 6.0) * coalesce(value, 0)) / (SELECT sum(pow(0.5, a / 6.0)) FROM (SELECT DISTINCT age AS a FROM ag)) AS mu, sum(pow(0.5, age / 6.0) * coalesce(fr, 0)) / (SELECT sum(pow(0.5, a / 6.0)) FROM (SELECT DISTINCT age AS a FROM ag)) AS mf FROM ag GROUP BY 1",
        "we": "SELECT factor_name, CASE WHEN sum(greatest(mu, 0)) OVER () > 0 THEN greatest(mu, 0) / sum(greatest(mu, 0)) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM me"}
x("M1_equal_weights", lambda m: combine.factor_weights(ic_history(m), "equal"), "factor_name", "weight", "SELECT factor_name, 1.0 / count(*) OVER () AS weight FROM me", HIST)
x("M2_ic_decay", lambda m: combine.factor_weights(ic_history(m), "ic_decay"), "factor_name", "weight", "SELECT * FROM we", HIST)
x("M2_factor_return_decay", lambda m: combine.factor_weights(ic_history(m, "factor_return"), "factor_return_decay"), "factor_name", "weight",
  "SELECT factor_name, CASE WHEN sum(greatest(mf, 0)) OVER () > 0 THEN greatest(mf, 0) / sum(greatest(mf, 0)) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM me", HIST)
x("M3_max_ic", lambda m: combine.factor_weights(ic_history(m), "max_ic"), "factor_name", "weight", "SELECT factor_name, CASE WHEN row_number() OVER (ORDER BY mu DESC, factor_name) = 1 THEN 1.0 ELSE 0.0 END AS weight FROM me", HIST)
query("M4_max_icir", lambda m: combine.factor_weights(ic_history(m), "max_icir"), "factor_name", "weight")
query("M5_pca", lambda m: combine.factor_weights(ic_history(m), "pca"), "factor_name", "weight")
query("M6_learned_ridge", lambda m: combine.learned_weights(cut(ic_history(m)), "ridge", latest_allowed="1999-12-31"), "factor_name", "weight")
query("M24_learned_lasso", lambda m: combine.learned_weights(cut(ic_history(m)), "lasso"), "factor_name", "weight")
query("C13_decay_weights", lambda m: m.month_ends.withColumn("age", F.months_between(F.lit("2002-01-01").cast("date"), F.trunc("signal_date", "MM")).cast("int")).select("signal_date", combine.decay_weight(F.col("age")).alias("w")), "signal_date", "w",
      ctes="signals", sql="SELECT signal_date, pow(0.5, date_diff('month', signal_date, DATE '2002-01-01') / 6.0) AS w FROM signals")
query("C14_nonnegative", lambda m: combine.normalise_nonnegative(m.table("supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("w")), ["s_nationkey"], "w", hot=True), "s_suppkey", "w",
      sql="SELECT s_suppkey, CASE WHEN sum(greatest(s_acctbal, 0)) OVER n > 0 THEN greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) OVER n ELSE 1.0 / count(*) OVER n END AS w FROM supplier WINDOW n AS (PARTITION BY s_nationkey)")


def score_rows(m):
    p = panel(m)
    h = evaluate.ic_matrix(p, hot=m.hot()).where("signal_date <= DATE'1999-12-31'").select("signal_date", "factor_name", F.col("rank_ic").alias("value"))
    return p.withColumnRenamed("raw_value", "value"), combine.factor_weights(h, "ic_decay")


SC = {**HIST, "sc": "SELECT signal_date, symbol, sum(raw_value * weight) / nullif(sum(CASE WHEN raw_value IS NOT NULL THEN weight END), 0) AS score FROM pan JOIN we USING (factor_name) GROUP BY 1, 2"}
x("M7_combined_scores", lambda m: combine.combine_scores(*score_rows(m)), "signal_date symbol", "score", "SELECT * FROM sc", SC)
x("M8_signed_scores", lambda m: (lambda r, w: combine.combine_scores(r, combine.signed(w, {"REVERSAL_5D": -1.0}), absolute=True))(*score_rows(m)), "signal_date symbol", "score",
  "SELECT signal_date, symbol, sum(raw_value * weight * CASE WHEN factor_name = 'REVERSAL_5D' THEN -1 ELSE 1 END) / nullif(sum(CASE WHEN raw_value IS NOT NULL THEN weight END), 0) AS score FROM pan JOIN we USING (factor_name) GROUP BY 1, 2", HIST)
x("W24_smoothed_scores", lambda m: research.smooth_scores(panel(m, ["VOLATILITY_20D"]).where("raw_value IS NOT NULL").select("signal_date", "symbol", F.col("raw_value").alias("score")), m.month_ends, 3), "signal_date symbol", "score",
  "SELECT * FROM (SELECT s.signal_date, g.symbol, avg(p.raw_value) OVER (PARTITION BY g.symbol ORDER BY s.signal_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS score FROM signals s, (SELECT DISTINCT symbol FROM pan WHERE factor_name = 'VOLATILITY_20D' AND raw_value IS NOT NULL) g LEFT JOIN pan p ON p.symbol = g.symbol AND p.signal_date = s.signal_date AND p.factor_name = 'VOLATILITY_20D') WHERE score IS NOT NULL")


def walk_weights(m):
    h = cut(evaluate.ic_matrix(panel(m), hot=m.hot()).select(F.lit("ALL_A").alias("index_code"), "signal_date", "factor_name", F.col("rank_ic").alias("value")))
    past = combine.walk_forward_history(h, h.select("index_code", "signal_date").distinct(), ["index_code"])
    w = combine.factor_weights(past, "ic_decay", ["index_code", "decision_date"])
    return combine.frozen_weights(w, ["index_code"], "1999-11-01", "2000-01-01")


WALK = {**ICM, "dd": "SELECT DISTINCT signal_date FROM icm",
        "pa": "SELECT d.signal_date AS decision_date, h.*, dense_rank() OVER (PARTITION BY d.signal_date ORDER BY h.signal_date DESC) - 1 AS age FROM dd d JOIN icm h ON h.signal_date < d.signal_date QUALIFY age < 12",
        "pb": "SELECT * FROM pa QUALIFY count(rank_ic) OVER (PARTITION BY decision_date, factor_name) > 0",
        "tt": "SELECT decision_date, sum(pow(0.5, age / 6.0)) AS t FROM (SELECT DISTINCT decision_date, age FROM pb) GROUP BY 1",
        "mm": "SELECT decision_date, factor_name, sum(pow(0.5, age / 6.0) * coalesce(rank_ic, 0)) / max(t) AS mu FROM pb JOIN tt USING (decision_date) GROUP BY ALL",
        "ww": "SELECT decision_date, factor_name, CASE WHEN sum(greatest(mu, 0)) OVER p > 0 THEN greatest(mu, 0) / sum(greatest(mu, 0)) OVER p ELSE 1.0 / count(*) OVER p END AS weight FROM mm WINDOW p AS (PARTITION BY decision_date)"}
x("M9_walk_forward_weights", walk_weights, "decision_date factor_name frozen", "weight",
  """SELECT decision_date, factor_name, weight, false AS frozen FROM ww WHERE decision_date < DATE '2000-01-01' UNION ALL
    SELECT l.decision_date, w.factor_name, w.weight, true FROM (SELECT DISTINCT decision_date FROM ww WHERE decision_date >= DATE '2000-01-01') l, ww w WHERE w.decision_date = (SELECT max(decision_date) FROM ww WHERE decision_date < DATE '2000-01-01')""", WALK)


def walk_portfolios(m, names=NAMES[:3], methods=("equal", "ic_decay")):
    p = panel(m, names).withColumn("index_code", F.lit("ALL_A"))
    mon = evaluate.monthly_statistics(p, ["index_code", "factor_name"], PERIODS, ["raw"], m.hot(), turnover=False)
    chosen = p.select("index_code", "factor_name").distinct()
    return research.walk_forward_combination(p, cut(mon), chosen, chosen.withColumn("sign", F.lit(1.0)), None, PERIODS, methods=methods, freeze_from="1999-12-01", test_start="2000-01-01", hot=m.hot())


query("M9_walk_forward_portfolios", lambda m: walk_portfolios(m)[2], "index_code method period", "months mean_turnover mean_long_short annual_return sharpe", ints="months")
query("M10_other_pool", lambda m: walk_portfolios(m, ["VOLATILITY_60D", "HIGH_60D_PROXIMITY"], ("equal", "max_ic"))[1], "signal_date index_code method", "group_1 turnover top_net_return")

# --- models -----------------------------------------------------------------------------
x("M11_feature_matrix", lambda m: models.feature_matrix(panel(m), NAMES), "signal_date symbol", [*NAMES, "forward_return"],
  "SELECT signal_date, symbol, " + ", ".join(f"max(raw_value) FILTER (factor_name = '{n}') AS {n}" for n in NAMES) + ", max(forward_return) AS forward_return FROM pan GROUP BY 1, 2")


def trained_medians(m):
    m = m.stored()
    wide = cut(models.feature_matrix(panel(m), NAMES))
    fill = models.medians(models.training_rows(wide, PERIODS["development"], asof.label_end_dates(m.month_ends, m.calendar)), NAMES)
    return wide.agg(*[F.lit(v).alias(n) for n, v in fill.items()])


DEV = "signal_date <= DATE '1998-12-31' AND signal_date IN (SELECT signal_date FROM plan WHERE exit_date <= DATE '1998-12-31')"
x("M12_training_medians", trained_medians, (), NAMES, "SELECT " + ", ".join(f"median(raw_value) FILTER (factor_name = '{n}') AS {n}" for n in NAMES) + f" FROM pan WHERE {DEV}")


def frozen(m, method="ols", names=("VOLATILITY_20D",), **kw):
    m = m.stored()
    wide = cut(models.feature_matrix(labelled_rows(m), names))
    return models.frozen(wide, list(names), PERIODS, method, label_ends=asof.label_end_dates(m.month_ends, m.calendar), hot=m.hot(), **kw)[0]


ONE = {"f1": "SELECT signal_date, symbol, raw_value AS v, forward_return FROM pan WHERE factor_name = 'VOLATILITY_20D'",
       "f2": f"SELECT *, coalesce(v, (SELECT median(v) FROM f1 WHERE {DEV})) AS iv FROM f1",
       "f3": f"SELECT regr_slope(forward_return, iv) AS b, regr_intercept(forward_return, iv) AS a FROM f2 WHERE forward_return IS NOT NULL AND {DEV}"}
x("M13_frozen_ols", frozen, "signal_date symbol", "prediction", "SELECT signal_date, symbol, a + b * iv AS prediction FROM f2, f3", ONE)
x("A23_model_predict", lambda m: frozen(m).where(F.col("signal_date") > "1998-12-31").withColumn("guard", formula.predict_guard(PERIODS["development"][1], "signal_date")), "signal_date symbol", "prediction",
  "SELECT signal_date, symbol, a + b * iv AS prediction FROM f2, f3 WHERE signal_date > DATE '1998-12-31'", ONE)
x("M25_latest_month_scored", lambda m: frozen(m).groupBy("signal_date").agg(F.count("prediction").alias("n"), F.count("forward_return").alias("labelled")), "signal_date", "n labelled",
  "SELECT signal_date, count(*) AS n, count(forward_return) AS labelled FROM f1 GROUP BY 1", ONE, ints="n labelled")
for name, method in (("M13_frozen_ridge", "ridge"), ("M27_frozen_lasso", "lasso"), ("M27_frozen_tree", "dtree")):
    query(name, lambda m, k=method: frozen(m, k, NAMES), "signal_date symbol", "prediction")
query("M13_rank_label", lambda m: frozen(m, "ridge", NAMES, label_mode="rank"), "signal_date symbol", "prediction")
RIDGE = {  # both factors centred and scaled over the training rows; a two by two system in closed form
    "w1": "SELECT signal_date, symbol, max(raw_value) FILTER (factor_name = 'VOLATILITY_20D') AS a, max(raw_value) FILTER (factor_name = 'REVERSAL_5D') AS b, max(forward_return) AS y FROM pan GROUP BY 1, 2",
    "w2": f"SELECT signal_date, symbol, y, coalesce(a, (SELECT median(a) FROM w1 WHERE {DEV})) AS a, coalesce(b, (SELECT median(b) FROM w1 WHERE {DEV})) AS b FROM w1",
    "w3": f"SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb, 1 + 1.0 / count(*) AS d FROM w2 WHERE y IS NOT NULL AND {DEV}",
    "w4": "SELECT *, (d * ca - r * cb) / (d * d - r * r) / sa AS wa, (d * cb - r * ca) / (d * d - r * r) / sb AS wb FROM w3",
}
TWO = ["VOLATILITY_20D", "REVERSAL_5D"]
x("M13_ridge_two_factors", lambda m: frozen(m, "ridge", TWO), "signal_date symbol", "prediction", "SELECT signal_date, symbol, my + wa * (a - ma) + wb * (b - mb) AS prediction FROM w2, w4", RIDGE)
x("M18_least_squares_two_factors", lambda m: frozen(m, "ols", TWO), "signal_date symbol", "prediction", "SELECT signal_date, symbol, my + wa * (a - ma) + wb * (b - mb) AS prediction FROM w2, w4", {**RIDGE, "w3": RIDGE["w3"].replace("1 + 1.0 / count(*)", "1.0")})
x("M13_rank_label_one_factor", lambda m: frozen(m, label_mode="rank"), "signal_date symbol", "prediction", "SELECT signal_date, symbol, a + b * iv AS prediction FROM f2, f5",
  {**ONE, "f4": "SELECT *, (rank() OVER (PARTITION BY signal_date ORDER BY forward_return) + (count(*) OVER (PARTITION BY signal_date, forward_return) - 1) / 2.0) / count(*) OVER (PARTITION BY signal_date) AS y FROM f2 WHERE forward_return IS NOT NULL",
   "f5": f"SELECT regr_slope(y, iv) AS b, regr_intercept(y, iv) AS a FROM f4 WHERE {DEV}"})

def tree_errors(m, method):
    """Errors of a tree model at its documented settings on its development rows, beside a constant's."""
    m = m.stored()
    wide = stored(models.feature_matrix(labelled_rows(m), NAMES))
    ends = asof.label_end_dates(m.month_ends, m.calendar)
    scored = models.frozen(wide, NAMES, PERIODS, method, label_ends=ends, hot=m.hot())[0]
    errors = models.fit_errors(models.training_rows(scored, PERIODS["development"], ends), "forward_return")
    return errors.withColumn("better", (F.col("model_error") < F.col("constant_error")).cast("int"))


for name, method in (("M27_forest_errors", "rf"), ("M27_boosted_errors", "xgb")):
    x(name, lambda m, k=method: tree_errors(m, k), (), "rows constant_error better", f"SELECT count(y) AS rows, stddev_pop(y) AS constant_error, 1 AS better FROM w1 WHERE {DEV}", {"w1": RIDGE["w1"]}, ints="rows better")
query("M6_learned_forest", lambda m: combine.learned_weights(stored(ic_history(m)), "rf"), "factor_name", "weight")
query("M18_full_training", lambda m: frozen(m, "ols", NAMES), "signal_date symbol", "prediction")
WALK_ONE = {"f1": ONE["f1"], "mo": "SELECT signal_date, row_number() OVER (ORDER BY signal_date) - 1 AS p FROM (SELECT DISTINCT signal_date FROM f1)",
            "re0": f"SELECT * FROM mo WHERE p >= 24 AND signal_date >= DATE '{PERIODS['development'][0]}' + {models.GRACE_DAYS} AND signal_date <= DATE '{PERIODS['validation'][1]}'",
            "re": "SELECT signal_date AS fit_on FROM re0 WHERE (p - (SELECT min(p) FROM re0)) % 12 = 0",
            "rm": "SELECT fit_on, median(v) AS md FROM re JOIN f1 ON signal_date < fit_on GROUP BY fit_on",
            "rf": "SELECT fit_on, max(md) AS md, regr_slope(forward_return, coalesce(v, md)) AS b, regr_intercept(forward_return, coalesce(v, md)) AS a FROM rm JOIN f1 ON signal_date < fit_on WHERE forward_return IS NOT NULL GROUP BY fit_on"}


def walked(m, names, method="ols", **kw):
    return models.walk_forward(stored(models.feature_matrix(panel(m, names), names)), names, PERIODS, method, hot=m.hot(), **kw)


x("M14_walk_forward_one_factor", lambda m: walked(m, ["VOLATILITY_20D"]), "signal_date symbol", "prediction",
  "SELECT f1.signal_date, f1.symbol, a + b * coalesce(v, md) AS prediction FROM f1 ASOF LEFT JOIN rf ON f1.signal_date >= rf.fit_on", WALK_ONE)
x("M14_refits", lambda m: walked(m, ["VOLATILITY_20D"], refit_months=12).groupBy("signal_date").agg(F.count("prediction").alias("scored"), F.avg("prediction").alias("mean")), "signal_date", "scored mean",
  "SELECT f1.signal_date, count(a) AS scored, avg(a + b * coalesce(v, md)) AS mean FROM f1 ASOF LEFT JOIN rf ON f1.signal_date >= rf.fit_on GROUP BY 1", WALK_ONE, ints="scored")
query("M14_walk_forward", lambda m: walked(m, NAMES), "signal_date symbol", "prediction")


def model_panel(m, methods=("ols", "ridge")):
    m = m.stored()
    wide = cut(models.feature_matrix(labelled_rows(m), NAMES))
    return research.model_run(wide, NAMES, PERIODS, methods, label_ends=asof.label_end_dates(m.month_ends, m.calendar), hot=m.hot())


query("M15_models_as_factors", lambda m: evaluate.evaluate_batch(cut(model_panel(m)), PERIODS, value_types=["raw"], hot=m.hot())[1], f"{VARIANT} period", "rank_ic hac_t bh_q_value")
query("M16_models_on_subset", lambda m: evaluate.monthly_statistics(cut(model_panel(m, ("lasso",))), periods=PERIODS, value_types=["raw"], hot=m.hot(), turnover=False), "signal_date factor_name orientation", "rank_ic")


def combination(m):
    p = panel(m)
    directions = p.select("factor_name").distinct().withColumn("direction", F.when(F.col("factor_name").like("VOL%"), "negative").otherwise("unknown"))
    return research.combination(p, directions, PERIODS, NAMES, hot=m.hot())


query("M17_combination", lambda m: combination(m)["summary"], f"{VARIANT} period", "rank_ic icir coverage")
x("M21_report_scores", lambda m: (lambda r, w: combine.combine_scores(r, w).join(combine.combine_scores(r, w.withColumn("weight", F.lit(1.0))).withColumnRenamed("score", "equal_score"), ["signal_date", "symbol"]))(*score_rows(m)), "signal_date symbol", "score equal_score",
  "SELECT * FROM sc JOIN (SELECT signal_date, symbol, avg(raw_value) AS equal_score FROM pan GROUP BY 1, 2) USING (signal_date, symbol)", SC)
query("M23_panels_for_window", lambda m: performance.union_all([panel(m, ["VOLATILITY_20D"]).where("signal_date < DATE'1998-01-01'"), panel(m, ["VOLATILITY_20D"]).where("signal_date >= DATE'1998-01-01'")]), "signal_date symbol factor_name", "raw_value",
      ctes=CTES, extra=PANEL, sql="SELECT * FROM pan WHERE factor_name = 'VOLATILITY_20D'")
x("M20_isolation_rows", lambda m: panel(m, ["VOLATILITY_20D"]).agg(F.count_if(F.col("signal_date") >= F.lit(PERIODS["test"][0]).cast("date")).alias("n")), (), "n", "SELECT count(*) AS n FROM pan WHERE factor_name = 'VOLATILITY_20D' AND signal_date >= DATE '2000-01-01'", ints="n")


def scored_documents(m):
    labelled = m.table("documents").join(m.table("labels"), "doc_id")
    fitted = models.text_model(labelled.select("doc_id", "text", F.col("quality").cast("double").alias("y")), "text", "y")
    return fitted.transform(m.table("documents")).select("doc_id", F.col("prediction").alias("score"))


query("A25_text_score", scored_documents, "doc_id", "score")
query("A26_embedding", lambda m: models.document_vectors(m.table("documents"), "text").select("doc_id", F.posexplode_outer("embedding").alias("place", "weight")).where("weight > 0"), "doc_id place", "weight", ints="place",
      sql=r"""SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS place, count(*) AS weight
        FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2""")
query("A27_document_agg", lambda m: formula.document_agg(m.table("documents"), "source", "n_chars", "mean", "mean_chars"), "source", "mean_chars", sql="SELECT source, avg(n_chars) AS mean_chars FROM documents GROUP BY 1")

# --- portfolios ----------------------------------------------------------------------------


def quintiles(m):
    m = m.stored()
    p = panel(m).withColumn("index_code", F.lit(INDEX_CODE))
    signs = p.select("factor_name").distinct().withColumn("sign", F.when(F.col("factor_name").like("VOL%"), -1.0).otherwise(1.0))
    return portfolio.quintile_portfolios(p, signs, asof.benchmark_forward(m.index_daily, m.month_end_plan), PERIODS, hot=m.hot())


QUINT = {
    "z1": "SELECT *, raw_value * CASE WHEN factor_name LIKE 'VOL%' THEN -1 ELSE 1 END AS s FROM pan WHERE raw_value IS NOT NULL AND forward_return IS NOT NULL",
    "z2": "SELECT *, row_number() OVER (PARTITION BY factor_name, signal_date ORDER BY s, symbol) AS r, count(*) OVER (PARTITION BY factor_name, signal_date) AS n FROM z1",
    "z3": "SELECT *, 6 - greatest(1, (5 * (r - 1) + n - 2) // (n - 1)) AS q FROM z2 WHERE n >= 25",
    "z4": "SELECT factor_name, signal_date, max(n) AS constituents, avg(forward_return) FILTER (q = 1) AS group_1, avg(forward_return) FILTER (q = 5) AS group_5, count(*) FILTER (q = 1) AS top, row_number() OVER (PARTITION BY factor_name ORDER BY signal_date) AS no FROM z3 GROUP BY 1, 2",
    "ho": "SELECT factor_name, no, symbol, 1.0 / top AS w FROM z3 JOIN z4 USING (factor_name, signal_date) WHERE q = 1",
    "ch": "SELECT coalesce(a.factor_name, b.factor_name) AS factor_name, coalesce(a.no, b.no + 1) AS no, coalesce(a.w, 0) - coalesce(b.w, 0) AS d FROM ho a FULL OUTER JOIN ho b ON a.factor_name = b.factor_name AND a.no = b.no + 1 AND a.symbol = b.symbol",
    "tv": "SELECT factor_name, no, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells FROM ch GROUP BY 1, 2",
    "ix2": "SELECT trade_date, avg(adj_open) AS op FROM bars GROUP BY trade_date",
    "be": "SELECT signal_date, b.op / a.op - 1 AS benchmark_return FROM plan JOIN ix2 a ON a.trade_date = entry_date JOIN ix2 b ON b.trade_date = exit_date",
    "q1": "SELECT z4.*, buys, sells, (buys + sells) / 2 AS turnover, (buys + sells) * 0.00082 + sells * 0.001 AS cost, benchmark_return FROM z4 JOIN tv USING (factor_name, no) LEFT JOIN be USING (signal_date)",
}
x("B1_quintile_portfolios", quintiles, "signal_date factor_name index_code", "constituents group_1 group_5 turnover cost top_net_return top_net_excess_return",
  f"SELECT *, '{INDEX_CODE}' AS index_code, group_1 - cost AS top_net_return, group_1 - cost - benchmark_return AS top_net_excess_return FROM q1", QUINT, ints="constituents")
x("B1_portfolio_metrics", lambda m: portfolio.portfolio_metrics(cut(quintiles(m)), ["index_code", "factor_name"]), "index_code factor_name period", "months mean_turnover mean_gross_return mean_net_return mean_net_excess_return net_information_ratio annual_return", 
  f"""SELECT '{INDEX_CODE}' AS index_code, factor_name, ph AS period, count(*) AS months, avg(turnover) AS mean_turnover, avg(group_1) AS mean_gross_return, avg(group_1 - cost) AS mean_net_return, avg(group_1 - cost - benchmark_return) AS mean_net_excess_return,
    avg(group_1 - cost - benchmark_return) * 12 / nullif(stddev_samp(group_1 - cost - benchmark_return) * sqrt(12), 0) AS net_information_ratio, pow(product(1 + group_1 - cost), 12.0 / count(*)) - 1 AS annual_return
    FROM (SELECT *, unnest(['all', CASE WHEN signal_date <= DATE '1998-12-31' THEN 'development' WHEN signal_date <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END]) AS ph FROM q1) GROUP BY factor_name, ph""", QUINT, ints="months", digits=6)
x("B2_turnover", lambda m: portfolio.turnover(selection.top_names(panel(m, ["MOMENTUM_60D"]).withColumnRenamed("raw_value", "score"), 10, hot=m.hot()).join(m.month_end_plan.select("signal_date", "period_no"), "signal_date").select(F.lit("x").alias("book"), "period_no", "symbol", F.col("target_weight").alias("weight")), ["book"]),
  "period_no", "buys sells turnover", "SELECT no AS period_no, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells, sum(abs(d)) / 2 AS turnover FROM c2 WHERE no <= (SELECT max(no) FROM h2) GROUP BY 1",
  {"h2": f"SELECT period_no AS no, symbol, 1.0 / count(*) OVER (PARTITION BY signal_date) AS w FROM (SELECT * FROM ({MOM}) QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY raw_value DESC, symbol) <= 10) JOIN plan USING (signal_date)",
   "c2": "SELECT coalesce(a.no, b.no + 1) AS no, coalesce(a.w, 0) - coalesce(b.w, 0) AS d FROM h2 a FULL OUTER JOIN h2 b ON a.no = b.no + 1 AND a.symbol = b.symbol"})
x("J15_holding_changes", lambda m: portfolio.holding_changes(selection.top_names(panel(m, ["MOMENTUM_60D"]).withColumnRenamed("raw_value", "score"), 10, hot=m.hot()).join(m.month_end_plan.select("signal_date", "period_no"), "signal_date").select(F.lit("x").alias("book"), "period_no", "symbol", F.col("target_weight").alias("weight")), ["book"]),
  "period_no symbol", "change", "SELECT coalesce(a.no, b.no + 1) AS period_no, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.w, 0) - coalesce(b.w, 0) AS change FROM h2 a FULL OUTER JOIN h2 b ON a.no = b.no + 1 AND a.symbol = b.symbol WHERE coalesce(a.no, b.no + 1) <= (SELECT max(no) FROM h2)",
  {"h2": f"SELECT period_no AS no, symbol, 1.0 / count(*) OVER (PARTITION BY signal_date) AS w FROM (SELECT * FROM ({MOM}) QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY raw_value DESC, symbol) <= 10) JOIN plan USING (signal_date)"})


def pool(m):
    m = m.stored()
    return m.marked_forward.join(pit.latest_on_dates(m.daily, m.month_ends, ["float_market_cap"]), ["signal_date", "symbol"])


POOL = {"po": "SELECT f.*, d.float_market_cap AS cap FROM mforward f ASOF JOIN daily d ON d.symbol = f.symbol AND f.signal_date >= d.trade_date"}
query("B3_cap_benchmark", lambda m: portfolio.weighted_benchmark(pool(m), "float_market_cap"), "signal_date", "benchmark_return missing_prices", ints="missing_prices", ctes="mforward daily", extra=POOL,
      sql="SELECT signal_date, sum(cap * forward_return) / sum(cap) AS benchmark_return, 0 AS missing_prices FROM po WHERE cap > 0 GROUP BY 1")
query("B3_index_weights", lambda m: portfolio.weighted_benchmark(portfolio.latest_index_weights(m.index_members, m.month_ends).join(m.marked_forward, ["signal_date", "symbol"], "left"), "benchmark_weight", ["index_code", "signal_date"], strict=False), "index_code signal_date", "benchmark_return missing_prices", ints="missing_prices",
      ctes="mforward members signals", sql="""SELECT index_code, s.signal_date, sum(benchmark_weight * forward_return) / sum(benchmark_weight) AS benchmark_return, count(*) FILTER (forward_return IS NULL) AS missing_prices FROM signals s
        JOIN members x ON x.valid_from = (SELECT max(valid_from) FROM members WHERE valid_from <= s.signal_date) LEFT JOIN mforward f ON f.signal_date = s.signal_date AND f.symbol = x.symbol GROUP BY 1, 2""")
query("B4_cash_benchmark", lambda m: portfolio.cash_benchmark(pool(m)), "signal_date", "benchmark_return equal_universe_return", ctes="mforward daily", extra=POOL,
      sql="SELECT signal_date, sum(cap * CASE WHEN tradable THEN forward_return ELSE 0 END) / greatest(sum(cap), 1) AS benchmark_return, sum(CASE WHEN cap > 0 AND tradable THEN forward_return ELSE 0 END) / greatest(count(*) FILTER (cap > 0), 1) AS equal_universe_return FROM po GROUP BY 1")
x("B5_spread_nav", lambda m: portfolio.spread_nav(monthly(m), VARIANT.split()), f"signal_date {VARIANT}", "net_value", f"SELECT signal_date, {', '.join(VARIANT.split())}, product(1 + group_1 - group_5) OVER (PARTITION BY {', '.join(VARIANT.split())} ORDER BY signal_date) AS net_value FROM mon", MONTHLY, neutral=True, digits=6)


def topn(m, n=10):
    m = m.stored()
    scores = panel(m, ["MOMENTUM_60D"]).select("signal_date", "symbol", F.col("raw_value").alias("score"))
    return portfolio.top_n_backtest(scores, m.marked_forward, m.month_end_plan, n, hot=m.hot())


TOPN = {"h3": f"SELECT p.signal_date, p.entry_date, p.exit_date, p.period_no AS no, k.symbol, 0.995 / count(*) OVER (PARTITION BY p.signal_date) AS w FROM (SELECT * FROM ({MOM}) QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY raw_value DESC, symbol) <= 10) k JOIN plan p USING (signal_date) WHERE p.exit_date IS NOT NULL",
        "g3": "SELECT h.signal_date, h.entry_date, h.exit_date, h.no, sum(w * coalesce(f.forward_return, 0)) AS gross_return, count(*) AS names FROM h3 h LEFT JOIN mforward f USING (signal_date, symbol) GROUP BY ALL",
        "c3": "SELECT coalesce(a.no, b.no + 1) AS no, coalesce(a.w, 0) - coalesce(b.w, 0) AS d FROM h3 a FULL OUTER JOIN h3 b ON a.no = b.no + 1 AND a.symbol = b.symbol",
        "t3": "SELECT no, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells FROM c3 GROUP BY 1",
        "b3": """SELECT *, CASE WHEN bps IS NULL THEN 0 ELSE buys * 0.00032 + sells * 0.00132 END AS explicit_cost, coalesce((buys + sells) * bps / 10000, 0) AS slippage_cost FROM (SELECT *, unnest(['gross', 'base_5bps', 'stress_10bps', 'stress_20bps']) AS scenario, unnest([NULL, 5.0, 10.0, 20.0]) AS bps FROM g3 JOIN t3 USING (no))"""}
x("B13_top_n_backtest", topn, "signal_date entry_date exit_date scenario", "gross_return buys sells explicit_cost slippage_cost portfolio_return names", "SELECT *, gross_return - explicit_cost - slippage_cost AS portfolio_return FROM b3", TOPN, ints="names")
query("B12_cost_scenarios", lambda m: portfolio.scenario_rows(m.month_ends), "signal_date scenario", "slippage_bps", ctes="signals", sql="SELECT signal_date, unnest(['gross', 'base_5bps', 'stress_10bps', 'stress_20bps']) AS scenario, unnest([NULL, 5.0, 10.0, 20.0]) AS slippage_bps FROM signals")


def period_table(m):
    returns = cut(topn(m))
    return portfolio.period_table(returns.join(portfolio.cash_benchmark(pool(m)), "signal_date"), PERIODS, [])


def period_sql(source: str, keys: str, per_year: float) -> str:
    """Relative performance and yearly costs of ``source`` (portfolio return p, benchmark b, buys, sells and costs) per key and period."""
    return f"""SELECT {keys}, period, count(*) AS periods, pow(product(1 + p), {per_year} / count(*)) - 1 AS annualized_return, pow(product((1 + p) / (1 + b)), {per_year} / count(*)) - 1 AS annualized_excess_return,
      avg((1 + p) / (1 + b) - 1) * sqrt({per_year}) / nullif(stddev_samp((1 + p) / (1 + b) - 1), 0) AS information_ratio, sum(buys + sells) * {per_year} / count(*) AS annual_turnover,
      sum(explicit_cost) * {per_year} / count(*) AS annual_explicit_cost, sum(slippage_cost) * {per_year} / count(*) AS annual_slippage_cost
      FROM (SELECT *, CASE WHEN signal_date <= DATE '1998-12-31' THEN 'development' WHEN signal_date <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS period FROM {source}) GROUP BY {keys}, period"""


CASH = "SELECT signal_date, sum(cap * CASE WHEN tradable THEN forward_return ELSE 0 END) / greatest(sum(cap), 1) AS b FROM {} GROUP BY 1"
x("B6_period_scenario_table", period_table, "scenario period", "periods annualized_return annualized_excess_return information_ratio annual_turnover annual_explicit_cost",
  period_sql("b6", "scenario", 12.0), {**TOPN, **POOL, "b4": CASH.format("po"), "b6": "SELECT b3.*, gross_return - explicit_cost - slippage_cost AS p, b FROM b3 JOIN b4 USING (signal_date)"}, ints="periods", digits=6)


def schedule_sql(frequency: str, per_year: float, methods=("MOMENTUM_60D", "REVERSAL_5D"), n: int = 10) -> tuple[dict, str]:
    """Top-n returns of some factors on one schedule under all cost scenarios: CTEs, and the period table."""
    f = frequency[0]
    dates = "SELECT signal_date FROM signals" if frequency == "monthly" else "SELECT max(trade_date) AS signal_date FROM cal GROUP BY date_trunc('week', trade_date + 2) HAVING date_trunc('week', max(trade_date) + 2) + INTERVAL 4 DAY <= (SELECT max(trade_date) FROM cal)"
    picked = " UNION ALL ".join(f"SELECT * FROM (SELECT signal_date, symbol, '{k}' AS method FROM {f}_values WHERE {k} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY {k} DESC, symbol) <= {n})" for k in methods)
    ctes = {
        f"{f}_dates": dates,
        f"{f}_plan": f"SELECT *, lead(entry_date) OVER (ORDER BY signal_date) AS exit_date, row_number() OVER (ORDER BY signal_date) AS no FROM (SELECT signal_date, next_session AS entry_date FROM {f}_dates JOIN calnext ON trade_date = signal_date)",
        f"{f}_marks": f"""SELECT g.symbol, g.trade_date, CASE WHEN g.session - q.session <= 60 THEN q.adj_open ELSE 0 END AS mark, g.session = q.session AS observed
          FROM (SELECT symbol, trade_date, session FROM (SELECT DISTINCT symbol FROM bars), calnext WHERE trade_date IN (SELECT entry_date FROM {f}_plan)) g
          ASOF JOIN (SELECT symbol, trade_date, adj_open, session FROM bars JOIN calnext USING (trade_date) WHERE adj_open > 0) q ON q.symbol = g.symbol AND g.trade_date >= q.trade_date""",
        f"{f}_forward": f"""SELECT p.signal_date, e.symbol, x.mark / nullif(e.mark, 0) - 1 AS forward_return, e.observed AS tradable FROM {f}_plan p JOIN {f}_marks e ON e.trade_date = p.entry_date
          JOIN {f}_marks x ON x.trade_date = p.exit_date AND x.symbol = e.symbol WHERE x.mark / nullif(e.mark, 0) IS NOT NULL""",
        f"{f}_values": f"SELECT s.signal_date, fac.* FROM (SELECT signal_date, symbol FROM {f}_dates, (SELECT DISTINCT symbol FROM fac)) s ASOF JOIN fac ON fac.symbol = s.symbol AND s.signal_date >= fac.trade_date",
        f"{f}_held": f"SELECT k.*, no, 0.995 / count(*) OVER (PARTITION BY method, signal_date) AS w FROM ({picked}) k JOIN {f}_plan USING (signal_date) WHERE exit_date IS NOT NULL",
        f"{f}_gross": f"SELECT method, h.signal_date, no, sum(w * coalesce(forward_return, 0)) AS gross_return FROM {f}_held h LEFT JOIN {f}_forward r ON r.signal_date = h.signal_date AND r.symbol = h.symbol GROUP BY ALL",
        f"{f}_moves": f"SELECT coalesce(a.method, b.method) AS method, coalesce(a.no, b.no + 1) AS no, coalesce(a.w, 0) - coalesce(b.w, 0) AS d FROM {f}_held a FULL OUTER JOIN {f}_held b ON a.method = b.method AND a.no = b.no + 1 AND a.symbol = b.symbol",
        f"{f}_traded": f"SELECT method, no, sum(greatest(d, 0)) AS buys, sum(greatest(-d, 0)) AS sells FROM {f}_moves GROUP BY 1, 2",
        f"{f}_pool": f"SELECT r.*, d.float_market_cap AS cap FROM {f}_forward r ASOF JOIN daily d ON d.symbol = r.symbol AND r.signal_date >= d.trade_date",
        f"{f}_cash": CASH.format(f"{f}_pool"),
        f"{f}_costs": f"""SELECT *, CASE WHEN bps IS NULL THEN 0 ELSE buys * 0.00032 + sells * 0.00132 END AS explicit_cost, coalesce((buys + sells) * bps / 10000, 0) AS slippage_cost
          FROM (SELECT *, unnest(['gross', 'base_5bps', 'stress_10bps', 'stress_20bps']) AS scenario, unnest([NULL, 5.0, 10.0, 20.0]) AS bps FROM {f}_gross JOIN {f}_traded USING (method, no))""",
        f"{f}_net": f"SELECT '{frequency}' AS schedule, c.*, gross_return - explicit_cost - slippage_cost AS p, b FROM {f}_costs c JOIN {f}_cash USING (signal_date)",
    }
    return ctes, period_sql(f"{f}_net", "schedule, method, scenario", per_year)


def schedules(m):
    o = m.table("orders").select(F.col("o_orderpriority").alias("schedule"), F.to_date("o_orderdate").alias("entry_date"), F.date_add("o_orderdate", 30).alias("exit_date"), "o_totalprice", "o_orderstatus")
    return o.where(F.col("o_orderstatus") != "P").groupBy("schedule", "entry_date", "exit_date").agg(F.sum("o_totalprice").alias("v"))


query("B7_common_window", lambda m: portfolio.common_window(schedules(m), ["schedule"]).groupBy("schedule").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")), "schedule", "n v", ints="n", digits=2,
      extra={"sd": "SELECT o_orderpriority AS schedule, o_orderdate::DATE AS a, o_orderdate::DATE + 30 AS b, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL"},
      sql="SELECT schedule, count(*) AS n, sum(v) AS v FROM sd WHERE a >= (SELECT max(x) FROM (SELECT min(a) AS x FROM sd GROUP BY schedule)) AND b <= (SELECT min(x) FROM (SELECT max(b) AS x FROM sd GROUP BY schedule)) GROUP BY 1")


def fills(m):
    notional = F.col("l_extendedprice")
    return m.trades.select("symbol", "trade_date", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("shares"), (notional / F.col("l_quantity")).alias("price"), notional.alias("notional"),
                           (notional * 0.0003).alias("commission"), F.when(F.col("l_returnflag") == "R", notional * 0.001).otherwise(0.0).alias("stamp_tax"), (notional * 0.00002).alias("transfer_fee"),
                           F.when(F.col("l_linestatus") == "F", "filled").otherwise("rejected").alias("status"))


FILL = {"fi": """SELECT symbol, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s, l_quantity AS q, l_extendedprice AS n, l_linestatus = 'F' AS done, l_extendedprice * 0.0003 + CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.001 ELSE 0 END + l_extendedprice * 0.00002 AS fee FROM trades"""}
FILLED = {"net": "SELECT symbol, trade_date, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net_shares FROM trades WHERE l_linestatus = 'F' GROUP BY 1, 2",
          "run": "SELECT *, sum(net_shares) OVER (PARTITION BY symbol ORDER BY trade_date) AS position FROM net"}
query("B8_replay_cash", lambda m: portfolio.replay(fills(m), 1e10)[0], (), "cash", ctes="trades", extra=FILL, sql="SELECT 1e10 - sum(s * n + fee) AS cash FROM fi WHERE done", digits=2)
query("B8_replay_positions", lambda m: portfolio.replay(fills(m), 1e10)[1], "symbol", "shares", ctes="trades", extra=FILL, sql="SELECT symbol, sum(s * q) AS shares FROM fi WHERE done GROUP BY 1")
query("B8_running_positions", lambda m: portfolio.running_positions(fills(m)), "symbol trade_date", "net_shares position", ctes="trades", extra=FILLED, sql="SELECT * FROM run")
query("B8_short_positions", lambda m: portfolio.short_positions(fills(m)), "symbol first_short", "lowest places", ints="places", ctes="trades", extra=FILLED,
      sql="SELECT symbol, min(trade_date) AS first_short, min(position) AS lowest, count(*) AS places FROM run WHERE position < 0 GROUP BY 1")
query("B9_cost_attribution", lambda m: portfolio.cost_attribution(fills(m), 5.0, ["symbol"]), "symbol", "notional explicit_cost slippage_cost filled_orders rejected_orders", ints="filled_orders rejected_orders", ctes="trades", extra=FILL, digits=4,
      sql="SELECT symbol, sum(n) FILTER (done) AS notional, sum(fee) FILTER (done) AS explicit_cost, sum(n) FILTER (done) * 0.0005 AS slippage_cost, count(*) FILTER (done) AS filled_orders, count(*) FILTER (NOT done) AS rejected_orders FROM fi GROUP BY 1")
query("B10_reject_reasons", lambda m: m.raw_daily.join(m.status, ["symbol", "trade_date"], "left").withColumn("side", F.when(F.col("volume") % 2 == 0, "buy").otherwise("sell")).select("symbol", "trade_date", portfolio.reject_reason().alias("reason")), "symbol trade_date reason", ctes="raw_daily status",
      sql="SELECT symbol, trade_date, CASE WHEN is_suspended THEN 'suspended' WHEN volume % 2 = 0 AND limit_up THEN 'limit_up' WHEN volume % 2 <> 0 AND limit_down THEN 'limit_down' END AS reason FROM raw_daily JOIN status USING (symbol, trade_date)")
query("B11_target_shares", lambda m: m.raw_daily.withColumn("target_weight", F.col("volume") / 1000).select("symbol", "trade_date", portfolio.target_shares(1e6).alias("shares")), "symbol trade_date", "shares", ints="shares", ctes="raw_daily",
      sql="SELECT symbol, trade_date, floor(1e6 * (volume / 1000) / open / 100) * 100 AS shares FROM raw_daily")
