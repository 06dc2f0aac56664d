"""Technical indicators T1-T40."""

from quantloom.catalog.registry import query
from quantloom.catalog.sql import div, ema, lagged, over, roll, with_ctes
from quantloom.operators import technical as t

KEY = "symbol trade_date"
RAW: dict[str, str] = {}  # unrounded SQL per indicator group


def check(name: str, group: str, columns: dict[str, str], source: str = "tb", extra: dict[str, str] | None = None, ctes: str = "", digits: int = 8) -> None:
    outputs = t.NAMES[group]
    assert list(columns) == outputs, (outputs, list(columns))
    body = ", ".join(f"{sql} AS {out}" for out, sql in columns.items())
    RAW[group] = with_ctes(f"SELECT symbol, trade_date, {body} FROM {source}", *(ctes or "tb").split(), extra=extra)
    query(name, lambda m: t.indicators(m.bars, outputs), KEY, outputs, ctes=(ctes or "tb").split(), extra=extra, digits=digits,
          sql=f"SELECT symbol, trade_date, {body} FROM {source}")


check("T1_bias", "BIAS", {f"BIAS_{w}D": f"c / {roll('c', w, max(1, int(w * .8)))} - 1" for w in t.BIAS_WINDOWS})


def trix(w: int) -> dict[str, str]:
    a = 2 / (w + 1)
    return {
        f"e{w}_1": ema("tb", "c", "x1", a, w),
        f"e{w}_2": ema(f"e{w}_1", "x1", "x2", a, w),
        f"e{w}_3": ema(f"e{w}_2", "x2", "x3", a, w),
        f"trix{w}": f"SELECT symbol, trade_date, x3 / nullif({lagged('x3')}, 0) - 1 AS trix{w} FROM e{w}_3",
    }


check("T2_trix", "TRIX", {"TRIX_12D": "trix12"}, "trix12", trix(12))
check("T3_trix_signal", "TRIX_SIGNAL",
      {f"TRIX_SIGNAL_{w}_{s}": roll(f"trix{w}", s, max(2, int(s * .8))) for w, s in t.TRIX_PAIRS},
      "trix5 JOIN trix12 USING (symbol, trade_date) JOIN trix20 USING (symbol, trade_date) JOIN trix60 USING (symbol, trade_date)",
      {**trix(5), **trix(12), **trix(20), **trix(60)})

rsi = {"g0": "SELECT symbol, trade_date, i, CASE WHEN c >= c1 THEN c - c1 WHEN c < c1 THEN 0.0 END AS up, CASE WHEN c <= c1 THEN c1 - c WHEN c > c1 THEN 0.0 END AS dn FROM tb"}
last = "g0"
for w in t.RSI_WINDOWS:
    rsi[f"gu{w}"] = ema(last, "up", f"up{w}", 2 / (w + 1), w)
    rsi[f"gd{w}"] = ema(f"gu{w}", "dn", f"dn{w}", 2 / (w + 1), w)
    last = f"gd{w}"
check("T4_rsi", "RSI", {f"RSI_{w}D": f"100 * {div(f'up{w}', f'up{w} + dn{w}')}" for w in t.RSI_WINDOWS}, last, rsi, digits=7)

kdj = {"k0": "SELECT symbol, trade_date, i, " + ", ".join(
    f"100 * {div('c - ' + roll('l', w, fn='min'), roll('h', w, fn='max') + ' - ' + roll('l', w, fn='min'))} AS rsv{w}" for w in t.KDJ_WINDOWS) + " FROM tb"}
last = "k0"
for w in t.KDJ_WINDOWS:
    kdj[f"kk{w}"] = ema(last, f"rsv{w}", f"k{w}", 1 / 3, 3)
    kdj[f"kd{w}"] = ema(f"kk{w}", f"k{w}", f"d{w}", 1 / 3, 3)
    last = f"kd{w}"
columns = {}
for w in t.KDJ_WINDOWS:
    columns |= {f"KDJ_RSV_{w}D": f"rsv{w}", f"KDJ_J_{w}D": f"3 * k{w} - 2 * d{w}"}
check("T5_kdj", "KDJ", columns | {"KDJ_K_9D": "k9", "KDJ_D_9D": "d9"}, last, kdj, digits=7)

cci = {"tp0": "SELECT *, (h + l + c) / 3 AS tp FROM tb",
       "tp1": "SELECT *, " + ", ".join(f"list(tp) {over(w)} AS v{w}" for w in t.CCI_WINDOWS) + " FROM tp0"}
check("T6_cci", "CCI", {f"CCI_{w}D": "CASE WHEN len(v{0}) >= {1} THEN {2} END".format(
    w, max(3, int(w * .8)), div(f"tp - list_avg(v{w})", f"0.015 * list_avg(list_transform(v{w}, lambda x: abs(x - list_avg(v{w}))))")) for w in t.CCI_WINDOWS},
    "tp1", cci, digits=6)

obv = {"ob": f"SELECT *, sum(coalesce(sign(c - c1), 0) * coalesce(v, 0)) {over()} AS obv FROM tb"}
check("T7_obv", "OBV", {"OBV": "obv"}, "ob", obv)
check("T8_maobv", "MAOBV", {f"MAOBV_{w}D": roll("obv", w) for w in (6, 20, 60)}, "ob", obv)
check("T9_bbi", "BBI", {"BBI_PCT": f"({' + '.join(roll('c', w, w) for w in (3, 6, 12, 20))}) / 4 / c - 1"})
dpo = {"dp": f"SELECT *, ({lagged('c', 11)} - {roll('c', 20, 16)}) / c AS dpo FROM tb"}
check("T10_dpo", "DPO", {"DPO_20D_PCT": "dpo"}, "dp", dpo)
check("T11_madpo", "MADPO", {"MADPO_20_10_6_PCT": roll("dpo", 6, 5)}, "dp", dpo)
roc = {"rc": f"SELECT *, c / {lagged('c', 12)} - 1 AS roc, (c - {lagged('c', 12)}) / c AS mtm FROM tb"}
check("T12_roc", "ROC", {"ROC_12D": "roc"}, "rc", roc)
check("T13_maroc", "MAROC", {"MAROC_12_6": roll("roc", 6, 5)}, "rc", roc)
check("T14_mtmma", "MTMMA", {"MTMMA_12_6_PCT": roll("mtm", 6, 5)}, "rc", roc)


def up(w: int) -> str:
    return roll("h", w, fn="max")


def dn(w: int) -> str:
    return roll("l", w, fn="min")


check("T15_wr", "WR", {f"WR_{w}D": f"-100 * {div(f'{up(w)} - c', f'{up(w)} - {dn(w)}')}" for w in (6, 14)})
psy = {"p0": "SELECT *, CASE WHEN c > c1 THEN 1.0 ELSE 0.0 END::DOUBLE AS rise FROM tb", "p1": f"SELECT *, 100 * {roll('rise', 12, 10)} AS psy FROM p0"}
check("T16_psy", "PSY", {"PSY_12D": "psy"}, "p1", psy)
check("T17_psyma", "PSYMA", {"PSYMA_12_6": roll("psy", 6, 5)}, "p1", psy)
streak = {
    "s0": f"""SELECT *, sum(CASE WHEN c > c1 THEN 0 ELSE 1 END) {over()} AS gu, sum(CASE WHEN c < c1 THEN 0 ELSE 1 END) {over()} AS gd FROM tb""",
    "s1": """SELECT *, sum(CASE WHEN c > c1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, gu ORDER BY trade_date) AS u,
      sum(CASE WHEN c < c1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, gd ORDER BY trade_date) AS d FROM s0""",
}
check("T18_streak", "STREAK", {"UP_STREAK": "u::DOUBLE", "DOWN_STREAK": "d::DOUBLE"}, "s1", streak)
days = {"d0": f"SELECT *, list(h) {over(20)} AS hs, list(l) {over(20)} AS ls FROM tb"}
check("T19_days_since", "DAYS_SINCE", {
    "DAYS_SINCE_HIGH_20D": "CASE WHEN len(hs) >= 16 THEN len(hs) - list_position(hs, list_max(hs)) END",
    "DAYS_SINCE_LOW_20D": "CASE WHEN len(ls) >= 16 THEN len(ls) - list_position(ls, list_min(ls)) END"}, "d0", days)
mass = {"m0": "SELECT symbol, trade_date, i, h - l AS rg FROM tb", "m1": ema("m0", "rg", "x1", 0.2, 9), "m2": ema("m1", "x1", "x2", 0.2, 9),
        "m3": f"SELECT *, {roll('(x1 / nullif(x2, 0))', 25, 20, 'sum')} AS mass FROM m2"}
check("T20_mass", "MASS", {"MASS_9_25": "mass"}, "m3", mass)
check("T21_mass_ma", "MASS_MA", {"MASS_MA_9_25_6": roll("mass", 6, 5)}, "m3", mass)
mfi = {"f0": f"SELECT *, (h + l + c) / 3 AS tp, (h + l + c) / 3 - {lagged('(h + l + c) / 3')} AS turn FROM tb",
       "f1": "SELECT *, CASE WHEN turn > 0 THEN tp * v ELSE 0 END AS pin, CASE WHEN turn < 0 THEN tp * v ELSE 0 END AS pout FROM f0"}
check("T22_mfi", "MFI", {"MFI_14D": f"100 - 100 / nullif(1 + {div(roll('pin', 14, 11, 'sum'), roll('pout', 14, 11, 'sum'))}, 0)"}, "f1", mfi)
vr = {"v0": "SELECT *, CASE WHEN c > c1 THEN v ELSE 0 END AS a, CASE WHEN c < c1 THEN v ELSE 0 END AS b, CASE WHEN c = c1 THEN v ELSE 0 END AS e FROM tb"}
check("T23_vr", "VR", {"VR_26D": f"100 * {div(roll('a', 26, 21, 'sum') + ' + 0.5 * ' + roll('e', 26, 21, 'sum'), roll('b', 26, 21, 'sum') + ' + 0.5 * ' + roll('e', 26, 21, 'sum'))}"}, "v0", vr)
emv = {"n0": f"SELECT *, ((h + l) / 2 - {lagged('(h + l) / 2')}) * (h - l) / v AS raw FROM tb", "n1": f"SELECT *, {roll('raw', 14, 11)} AS emv FROM n0"}
check("T24_emv", "EMV", {"EMV_14D": "emv"}, "n1", emv, digits=4)
check("T25_maemv", "MAEMV", {"MAEMV_14_9": roll("emv", 9, 7)}, "n1", emv, digits=4)
check("T26_ar", "AR", {"AR_26D": f"100 * {div(roll('(h - o)', 26, 21, 'sum'), roll('(o - l)', 26, 21, 'sum'))}"}, digits=5)
br = {"b0": "SELECT *, CASE WHEN h < c1 THEN 0 ELSE h - c1 END AS bu, CASE WHEN c1 < l THEN 0 ELSE c1 - l END AS bd FROM tb"}
check("T27_br", "BR", {"BR_26D": f"100 * {div(roll('bu', 26, 21, 'sum'), roll('bd', 26, 21, 'sum'))}"}, "b0", br, digits=6)
cr = {"r0": f"SELECT *, {lagged('(h + l) / 2')} AS pm FROM tb", "r1": "SELECT *, CASE WHEN h < pm THEN 0 ELSE h - pm END AS bu, CASE WHEN pm < l THEN 0 ELSE pm - l END AS bd FROM r0"}
check("T28_cr", "CR", {"CR_20D": f"100 * {div(roll('bu', 20, 16, 'sum'), roll('bd', 20, 16, 'sum'))}"}, "r1", cr, digits=6)
dmi = {"d0": "SELECT *, CASE WHEN h - h1 > l1 - l AND h - h1 > 0 THEN h - h1 ELSE 0 END AS pdm, CASE WHEN l1 - l > h - h1 AND l1 - l > 0 THEN l1 - l ELSE 0 END AS mdm FROM tr",
       "d1": f"SELECT *, 100 * {div(roll('pdm', 14, 11), roll('tr', 14, 11))} AS pdi, 100 * {div(roll('mdm', 14, 11), roll('tr', 14, 11))} AS mdi FROM d0",
       "d2": "SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM d1", "d3": f"SELECT *, {roll('dx', 6, 5)} AS adx FROM d2"}
check("T29_dmi", "DMI", {"DMI_PDI_14_6": "pdi", "DMI_MDI_14_6": "mdi", "DMI_ADX_14_6": "adx", "DMI_ADXR_14_6": f"(adx + {lagged('adx', 6)}) / 2"}, "d3", dmi, "tr", digits=7)

macd, last = {}, "tb"
for w in (5, 10, 12, 20, 26, 50):
    macd[f"ma{w}"] = ema(last, "c", f"ema{w}", 2 / (w + 1), w)
    last = f"ma{w}"
columns = {}
for f, s, g in t.MACD_SETS:
    macd[f"dif{s}"] = f"SELECT *, ema{f} - ema{s} AS dif{s} FROM {last}"
    macd[f"dea{s}"] = ema(f"dif{s}", f"dif{s}", f"dea{s}", 2 / (g + 1), g)
    last = f"dea{s}"
    columns |= {f"MACD_DIF_{f}_{s}_{g}_PCT": f"dif{s} / c", f"MACD_DEA_{f}_{s}_{g}_PCT": f"dea{s} / c", f"MACD_HIST_{f}_{s}_{g}_PCT": f"2 * (dif{s} - dea{s}) / c"}
check("T30_macd", "MACD", columns, last, macd)
check("T31_atr", "ATR", {f"ATR_{w}D_PCT": f"{roll('tr', w)} / c" for w in t.ATR_WINDOWS}, "tr", ctes="tr")


def sd(w: int) -> str:
    return roll("c", w, fn="stddev_samp")


columns = {}
for w in (10, 20):
    columns |= {f"BBANDS_WIDTH_{w}_2": f"4 * {sd(w)} / {roll('c', w)}",
                f"BBANDS_POSITION_{w}_2": div(f"c - {roll('c', w)} + 2 * {sd(w)}", f"4 * {sd(w)}")}
check("T32_bbands", "BBANDS", columns)
check("T33_boll", "BOLL", {"BOLL_LOWER_20D_PCT": f"({roll('c', 20)} - 2 * {sd(20)}) / c - 1", "BOLL_MID_20D_PCT": f"{roll('c', 20)} / c - 1",
                          "BOLL_UPPER_20D_PCT": f"({roll('c', 20)} + 2 * {sd(20)}) / c - 1"})
columns = {}
for w in (20, 60):
    columns |= {f"DONCHIAN_POSITION_{w}D": div(f"c - {dn(w)}", f"{up(w)} - {dn(w)}"), f"DONCHIAN_WIDTH_{w}D": f"({up(w)} - {dn(w)}) / c"}
columns |= {"DONCHIAN_LOWER_20D_PCT": f"{dn(20)} / c - 1", "DONCHIAN_MID_20D_PCT": f"({up(20)} + {dn(20)}) / 2 / c - 1", "DONCHIAN_UPPER_20D_PCT": f"{up(20)} / c - 1"}
check("T34_donchian", "DONCHIAN", columns)
asi = {"a0": "SELECT *, abs(h - c1) AS a, abs(l - c1) AS b, abs(h - l1) AS e, abs(c1 - o1) AS d, c - c1 + 0.5 * (c - o) + c1 - o1 AS x FROM tb",
       "a1": """SELECT *, 50 * x * greatest(a, b) / nullif(CASE WHEN a >= b AND a >= e THEN a + 0.5 * b + 0.25 * d
         WHEN b > a AND b >= e THEN b + 0.5 * a + 0.25 * d ELSE e + 0.25 * d END, 0) / 26 AS si FROM a0""",
       "a2": f"SELECT *, {roll('si', 26, 21, 'sum')} AS asi FROM a1"}
check("T35_asi", "ASI", {"ASI_26D": "asi"}, "a2", asi, digits=5)
check("T36_asit", "ASIT", {"ASIT_26_10": roll("asi", 10, 8)}, "a2", asi, digits=5)
dfma = {"w0": f"SELECT *, {roll('c', 10, 8)} - {roll('c', 50, 40)} AS dif FROM tb"}
check("T37_dfma", "DFMA", {"DFMA_DIF_10_50_PCT": "dif / c", "DFMA_SIGNAL_10_50_10_PCT": f"{roll('dif', 10, 8)} / c"}, "w0", dfma)
check("T38_expma", "EXPMA", {"EXPMA_12D_PCT": "x12 / c - 1", "EXPMA_50D_PCT": "x50 / c - 1"}, "q50",
      {"q12": ema("tb", "c", "x12", 2 / 13, 12), "q50": ema("q12", "c", "x50", 2 / 51, 50)})
kelt = {"q20": ema("tr", "c", "m", 2 / 21, 20), "q21": f"SELECT *, {roll('tr', 10, 8)} AS a FROM q20"}
check("T39_keltner", "KELTNER", {"KELTNER_LOWER_20_10_PCT": "(m - a) / c - 1", "KELTNER_MID_20_10_PCT": "m / c - 1", "KELTNER_UPPER_20_10_PCT": "(m + a) / c - 1"}, "q21", kelt, "tr")
query("T40_aliases", lambda m: t.indicators(m.bars, ["mtm_bfq", "obv_bfq", "atr_bfq"]), KEY, "mtm_bfq obv_bfq atr_bfq", ctes="tr",
      extra={"al": f"SELECT *, sum(coalesce(sign(c - c1), 0) * coalesce(v, 0)) {over()} AS obv FROM tr"},
      sql=f"SELECT symbol, trade_date, c / {lagged('c', 12)} - 1 AS mtm_bfq, obv AS obv_bfq, {roll('tr', 20)} / c AS atr_bfq FROM al")
