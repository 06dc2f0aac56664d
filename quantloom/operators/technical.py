"""The 98 technical indicators as layered window columns.

An indicator adds columns to numbered layers; every layer is one projection,
so all indicators asked for share the same sorts. Averages with memory (EMA)
run once between the early and the late layers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.ewm import Deviation, Quotient, Rolling, Step, add_averages
from quantloom.functions.rolling import frame, history, lag, rolling, sample_std, so_far
from quantloom.functions.scalar import at_least, ratio

KEYS = ("symbol", "trade_date")

# Vendor names that equal one output, and vendor names without a public formula.
ALIASES = {
    "mtm_bfq": "ROC_12D",
    "atr_bfq": "ATR_20D_PCT",
    "cci_bfq": "CCI_14D",
    "kdj_bfq": "KDJ_J_9D",
    "obv_bfq": "OBV",
    "macd_dif_bfq": "MACD_DIF_12_26_9_PCT",
    "macd_dea_bfq": "MACD_DEA_12_26_9_PCT",
    "macd_bfq": "MACD_HIST_12_26_9_PCT",
}
BLOCKED = ("xsii_td1_bfq", "xsii_td2_bfq", "xsii_td3_bfq", "xsii_td4_bfq")

# Windows of the registered outputs.
BIAS_WINDOWS = (5, 6, 12, 20, 24, 60, 120)
TRIX_PAIRS = ((5, 3), (12, 9), (20, 12), (60, 20), (12, 20))
RSI_WINDOWS = (6, 12, 24, 60)
KDJ_WINDOWS = (5, 9, 14, 20)
CCI_WINDOWS = (5, 14, 20, 60)
MACD_SETS = ((5, 20, 5), (12, 26, 9), (10, 50, 10))
ATR_WINDOWS = (6, 14, 20, 60)

NAMES: dict[str, list[str]] = {
    "BIAS": [f"BIAS_{w}D" for w in BIAS_WINDOWS],
    "TRIX": ["TRIX_12D"],
    "TRIX_SIGNAL": [f"TRIX_SIGNAL_{w}_{s}" for w, s in TRIX_PAIRS],
    "RSI": [f"RSI_{w}D" for w in RSI_WINDOWS],
    "KDJ": [f"KDJ_{o}_{w}D" for w in KDJ_WINDOWS for o in ("RSV", "J")] + ["KDJ_K_9D", "KDJ_D_9D"],
    "CCI": [f"CCI_{w}D" for w in CCI_WINDOWS],
    "OBV": ["OBV"],
    "MAOBV": [f"MAOBV_{w}D" for w in (6, 20, 60)],
    "BBI": ["BBI_PCT"],
    "DPO": ["DPO_20D_PCT"],
    "MADPO": ["MADPO_20_10_6_PCT"],
    "ROC": ["ROC_12D"],
    "MAROC": ["MAROC_12_6"],
    "MTMMA": ["MTMMA_12_6_PCT"],
    "WR": ["WR_6D", "WR_14D"],
    "PSY": ["PSY_12D"],
    "PSYMA": ["PSYMA_12_6"],
    "STREAK": ["UP_STREAK", "DOWN_STREAK"],
    "DAYS_SINCE": ["DAYS_SINCE_HIGH_20D", "DAYS_SINCE_LOW_20D"],
    "MASS": ["MASS_9_25"],
    "MASS_MA": ["MASS_MA_9_25_6"],
    "MFI": ["MFI_14D"],
    "VR": ["VR_26D"],
    "EMV": ["EMV_14D"],
    "MAEMV": ["MAEMV_14_9"],
    "AR": ["AR_26D"],
    "BR": ["BR_26D"],
    "CR": ["CR_20D"],
    "DMI": [f"DMI_{o}_14_6" for o in ("PDI", "MDI", "ADX", "ADXR")],
    "MACD": [f"MACD_{o}_{f}_{s}_{g}_PCT" for f, s, g in MACD_SETS for o in ("DIF", "DEA", "HIST")],
    "ATR": [f"ATR_{w}D_PCT" for w in ATR_WINDOWS],
    "BBANDS": [f"BBANDS_{o}_{w}_2" for w in (10, 20) for o in ("WIDTH", "POSITION")],
    "BOLL": [f"BOLL_{o}_20D_PCT" for o in ("LOWER", "MID", "UPPER")],
    "DONCHIAN": [f"DONCHIAN_{o}_{w}D" for w in (20, 60) for o in ("POSITION", "WIDTH")]
    + [f"DONCHIAN_{o}_20D_PCT" for o in ("LOWER", "MID", "UPPER")],
    "ASI": ["ASI_26D"],
    "ASIT": ["ASIT_26_10"],
    "DFMA": ["DFMA_DIF_10_50_PCT", "DFMA_SIGNAL_10_50_10_PCT"],
    "EXPMA": ["EXPMA_12D_PCT", "EXPMA_50D_PCT"],
    "KELTNER": [f"KELTNER_{o}_20_10_PCT" for o in ("LOWER", "MID", "UPPER")],
}
ALL_NAMES = tuple(n for names in NAMES.values() for n in names)
GROUP_OF = {n: g for g, names in NAMES.items() for n in names}

AVERAGE_LAYER = 5  # EMAs run after this layer
LATE = AVERAGE_LAYER + 1  # and what reads them here, row by row: windows over EMAs are steps of the same pass

def _r(source: str | Column, window: int, minimum: int | None = None, fn=F.avg) -> Column:
    return rolling(source, window, minimum, fn)


class Board:
    """Columns per layer, EMA steps and what the caller keeps."""

    def __init__(self) -> None:
        self.layers: dict[int, dict[str, Column]] = {}
        self.steps: dict[str, Step | Deviation | Quotient | Rolling] = {}
        # adjusted close, high, low, open and volume (0 as null)
        self.c, self.h, self.l, self.o, self.v = (F.col(f"__{x}") for x in "chlov")

    def put(self, layer: int, **columns: Column) -> None:
        self.layers.setdefault(layer, {}).update(columns)

    def average(self, *steps: Step | Deviation | Quotient | Rolling) -> None:
        for step in steps:
            self.steps.setdefault(step.out, step)


def _previous(b: Board) -> None:
    c = b.c
    b.put(0, __c1=lag(c), __delta=c - lag(c))


def _true_range(b: Board) -> None:
    h, l = b.h, b.l  # noqa: E741
    _previous(b)
    # greatest skips the null previous close of the first row
    b.put(1, __tr=F.greatest(h - l, F.abs(h - F.col("__c1")), F.abs(l - F.col("__c1"))))


def _band(b: Board, w: int) -> None:
    c = b.c
    b.put(1, **{f"__mid{w}": _r(c, w), f"__std{w}": _r(c, w, fn=sample_std)})


def _channel(b: Board, w: int) -> None:
    h, l = b.h, b.l  # noqa: E741
    b.put(1, **{f"__up{w}": _r(h, w, fn=F.max), f"__dn{w}": _r(l, w, fn=F.min)})


def bias(b: Board, names) -> None:
    c = b.c
    for w in BIAS_WINDOWS:
        b.put(1, **{f"BIAS_{w}D": ratio(c, _r(c, w, max(1, int(w * 0.8)))) - 1})


def trix(b: Board, names) -> None:
    windows = sorted({int(re.findall(r"\d+", n)[0]) for n in names})
    for w in windows:
        b.average(
            Step(f"__e1_{w}", "__c", w, span=w),
            Step(f"__e2_{w}", f"__e1_{w}", w, span=w),
            Step(f"__e3_{w}", f"__e2_{w}", w, span=w),
        )
        b.average(Quotient(f"__trix{w}", f"__e3_{w}", f"__e3_{w}", back=1, less=1.0))
    if 12 in windows:
        b.put(LATE, TRIX_12D=F.col("__trix12"))
    for w, s in TRIX_PAIRS:
        if w in windows:
            b.average(Rolling(f"TRIX_SIGNAL_{w}_{s}", f"__trix{w}", s, max(2, int(s * 0.8))))


def rsi(b: Board, names) -> None:
    _previous(b)
    d = F.col("__delta")
    b.put(1, __gain=at_least(d, 0.0), __loss=at_least(-d, 0.0))
    for w in RSI_WINDOWS:
        if f"RSI_{w}D" in names:
            b.average(Step(f"__gain{w}", "__gain", w, span=w), Step(f"__loss{w}", "__loss", w, span=w))
            gain, loss = F.col(f"__gain{w}"), F.col(f"__loss{w}")
            b.put(LATE, **{f"RSI_{w}D": 100 * ratio(gain, gain + loss)})


def kdj(b: Board, names) -> None:
    c = b.c
    for w in KDJ_WINDOWS:
        if not any(n.endswith(f"_{w}D") for n in names):
            continue
        _channel(b, w)
        up, dn = F.col(f"__up{w}"), F.col(f"__dn{w}")
        b.put(2, **{f"KDJ_RSV_{w}D": 100 * ratio(c - dn, up - dn)})
        if any(n.endswith(f"_{w}D") and "RSV" not in n for n in names):
            b.average(
                Step(f"KDJ_K_{w}D", f"KDJ_RSV_{w}D", 3, alpha=1 / 3), Step(f"KDJ_D_{w}D", f"KDJ_K_{w}D", 3, alpha=1 / 3)
            )
            b.put(LATE, **{f"KDJ_J_{w}D": 3 * F.col(f"KDJ_K_{w}D") - 2 * F.col(f"KDJ_D_{w}D")})


def cci(b: Board, names) -> None:
    c, h, l = b.c, b.h, b.l  # noqa: E741
    b.put(0, __tp=(h + l + c) / 3)
    tp = F.col("__tp")
    for w in CCI_WINDOWS:
        if f"CCI_{w}D" in names:
            b.put(1, **{f"__tpm{w}": _r(tp, w)})
            b.average(Deviation(f"__tpd{w}", "__tp", w, max(3, int(w * 0.8))))
            b.put(LATE, **{f"CCI_{w}D": ratio(tp - F.col(f"__tpm{w}"), 0.015 * F.col(f"__tpd{w}"))})


def obv(b: Board, names) -> None:
    v = b.v
    _previous(b)
    flow = F.coalesce(F.signum("__delta"), F.lit(0.0)) * F.coalesce(v, F.lit(0.0))
    b.put(1, OBV=F.sum(flow).over(so_far()))
    for w in (6, 20, 60):
        b.put(2, **{f"MAOBV_{w}D": _r("OBV", w)})


def bbi(b: Board, names) -> None:
    c = b.c
    mean = sum((_r(c, w, w) for w in (3, 6, 12, 20)), F.lit(0.0)) / 4
    b.put(1, BBI_PCT=ratio(mean, c) - 1)


def dpo(b: Board, names) -> None:
    c = b.c
    b.put(1, DPO_20D_PCT=ratio(lag(c, 11) - _r(c, 20, 16), c))
    b.put(2, MADPO_20_10_6_PCT=_r("DPO_20D_PCT", 6, 5))


def roc(b: Board, names) -> None:
    c = b.c
    b.put(1, ROC_12D=ratio(c, lag(c, 12)) - 1)
    b.put(2, MAROC_12_6=_r("ROC_12D", 6, 5))


def mtmma(b: Board, names) -> None:
    c = b.c
    b.put(1, __mtm=ratio(c - lag(c, 12), c))
    b.put(2, MTMMA_12_6_PCT=_r("__mtm", 6, 5))


def wr(b: Board, names) -> None:
    c = b.c
    for w in (6, 14):
        _channel(b, w)
        up, dn = F.col(f"__up{w}"), F.col(f"__dn{w}")
        b.put(2, **{f"WR_{w}D": -100 * ratio(up - c, up - dn)})


def psy(b: Board, names) -> None:
    _previous(b)
    b.put(1, __rise=F.coalesce((F.col("__delta") > 0).cast("double"), F.lit(0.0)))
    b.put(2, PSY_12D=100 * _r("__rise", 12, 10))
    b.put(3, PSYMA_12_6=_r("PSY_12D", 6, 5))


def streak(b: Board, names) -> None:
    """Length of the current run: row number minus the row number of the last break."""
    _previous(b)
    row = F.row_number().over(history())
    b.put(1, __row=row)
    for name, holds in (("UP_STREAK", F.col("__delta") > 0), ("DOWN_STREAK", F.col("__delta") < 0)):
        broken = F.when(~F.coalesce(holds, F.lit(False)), F.col("__row"))
        b.put(2, **{name: (F.col("__row") - F.max(broken).over(so_far())).cast("double")})


def days_since(b: Board, names) -> None:
    """Rows since the window's extreme; the earliest of equal extremes counts."""
    h, l = b.h, b.l  # noqa: E741
    b.put(0, __row0=F.row_number().over(history()))
    over = frame(20)
    row = F.col("__row0")
    top = F.max(F.struct(h.alias("x"), (-row).alias("r"))).over(over)["r"]
    bottom = F.min(F.struct(l.alias("x"), row.alias("r"))).over(over)["r"]
    b.put(1, DAYS_SINCE_HIGH_20D=F.when(F.count(h).over(over) >= 16, (row + top).cast("double")))
    b.put(1, DAYS_SINCE_LOW_20D=F.when(F.count(l).over(over) >= 16, (row - bottom).cast("double")))


def mass(b: Board, names) -> None:
    h, l = b.h, b.l  # noqa: E741
    b.put(0, __range=h - l)
    b.average(
        Step("__m1", "__range", 9, span=9), Step("__m2", "__m1", 9, span=9), Quotient("__mass", "__m1", "__m2"),
        Rolling("MASS_9_25", "__mass", 25, 20, total=True), Rolling("MASS_MA_9_25_6", "MASS_9_25", 6, 5),
    )


def mfi(b: Board, names) -> None:
    c, h, l, v = b.c, b.h, b.l, b.v  # noqa: E741
    b.put(0, __tp=(h + l + c) / 3)
    tp = F.col("__tp")
    b.put(1, __flow=tp * v, __turn=tp - lag(tp))
    flow, turn = F.col("__flow"), F.coalesce(F.col("__turn"), F.lit(0.0))
    b.put(2, __in=F.when(turn > 0, flow).otherwise(F.lit(0.0)), __out=F.when(turn < 0, flow).otherwise(F.lit(0.0)))
    share = ratio(_r("__in", 14, 11, F.sum), _r("__out", 14, 11, F.sum))
    b.put(3, MFI_14D=100 - F.try_divide(F.lit(100.0), 1 + share))


def vr(b: Board, names) -> None:
    v = b.v
    _previous(b)
    d = F.col("__delta")
    zero = F.lit(0.0)
    b.put(1, __vu=F.when(d > 0, v).otherwise(zero), __vd=F.when(d < 0, v).otherwise(zero), __vf=F.when(d == 0, v).otherwise(zero))
    up, down, flat = (_r(x, 26, 21, F.sum) for x in ("__vu", "__vd", "__vf"))
    b.put(2, VR_26D=100 * ratio(up + 0.5 * flat, down + 0.5 * flat))


def emv(b: Board, names) -> None:
    h, l, v = b.h, b.l, b.v  # noqa: E741
    b.put(0, __half=(h + l) / 2)
    half = F.col("__half")
    b.put(1, __emv=F.try_divide((half - lag(half)) * (h - l), v))
    b.put(2, EMV_14D=_r("__emv", 14, 11))
    b.put(3, MAEMV_14_9=_r("EMV_14D", 9, 7))


def ar(b: Board, names) -> None:
    h, l, o = b.h, b.l, b.o  # noqa: E741
    b.put(1, AR_26D=100 * ratio(_r(h - o, 26, 21, F.sum), _r(o - l, 26, 21, F.sum)))


def br(b: Board, names) -> None:
    h, l = b.h, b.l  # noqa: E741
    _previous(b)
    c1 = F.col("__c1")
    b.put(1, __bu=at_least(h - c1, 0.0), __bd=at_least(c1 - l, 0.0))
    b.put(2, BR_26D=100 * ratio(_r("__bu", 26, 21, F.sum), _r("__bd", 26, 21, F.sum)))


def cr(b: Board, names) -> None:
    h, l = b.h, b.l  # noqa: E741
    b.put(0, __mid1=lag((h + l) / 2))
    m = F.col("__mid1")
    b.put(1, __cu=at_least(h - m, 0.0), __cd=at_least(m - l, 0.0))
    b.put(2, CR_20D=100 * ratio(_r("__cu", 20, 16, F.sum), _r("__cd", 20, 16, F.sum)))


def dmi(b: Board, names) -> None:
    h, l = b.h, b.l  # noqa: E741
    _true_range(b)
    b.put(0, __hc=h - lag(h), __lc=lag(l) - l)
    hc, lc, zero = F.col("__hc"), F.col("__lc"), F.lit(0.0)
    b.put(1, __pdm=F.when((hc > lc) & (hc > 0), hc).otherwise(zero), __mdm=F.when((lc > hc) & (lc > 0), lc).otherwise(zero))
    tr = _r("__tr", 14, 11)
    b.put(2, DMI_PDI_14_6=100 * ratio(_r("__pdm", 14, 11), tr), DMI_MDI_14_6=100 * ratio(_r("__mdm", 14, 11), tr))
    p, m = F.col("DMI_PDI_14_6"), F.col("DMI_MDI_14_6")
    b.put(3, __dx=100 * ratio(F.abs(p - m), p + m))
    b.put(4, DMI_ADX_14_6=_r("__dx", 6, 5))
    adx = F.col("DMI_ADX_14_6")
    b.put(5, DMI_ADXR_14_6=(adx + lag(adx, 6)) / 2)


def macd(b: Board, names) -> None:
    c = b.c
    for f, s, g in MACD_SETS:
        tag = f"{f}_{s}_{g}"
        if not any(tag in n for n in names):
            continue
        b.average(
            Step(f"__ema{f}", "__c", f, span=f),
            Step(f"__ema{s}", "__c", s, span=s),
            Step(f"__dea{tag}", f"__ema{f}", g, span=g, minus=f"__ema{s}"),
        )
        dif, dea = F.col(f"__ema{f}") - F.col(f"__ema{s}"), F.col(f"__dea{tag}")
        b.put(
            LATE,
            **{
                f"MACD_DIF_{tag}_PCT": ratio(dif, c),
                f"MACD_DEA_{tag}_PCT": ratio(dea, c),
                f"MACD_HIST_{tag}_PCT": ratio(2 * (dif - dea), c),
            },
        )


def atr(b: Board, names) -> None:
    c = b.c
    _true_range(b)
    for w in ATR_WINDOWS:
        b.put(2, **{f"ATR_{w}D_PCT": ratio(_r("__tr", w), c)})


def bbands(b: Board, names) -> None:
    c = b.c
    for w in (10, 20):
        _band(b, w)
        mid, std = F.col(f"__mid{w}"), F.col(f"__std{w}")
        upper, lower = mid + 2 * std, mid - 2 * std
        b.put(2, **{f"BBANDS_WIDTH_{w}_2": ratio(upper - lower, mid), f"BBANDS_POSITION_{w}_2": ratio(c - lower, upper - lower)})


def boll(b: Board, names) -> None:
    c = b.c
    _band(b, 20)
    mid, std = F.col("__mid20"), F.col("__std20")
    b.put(
        2,
        BOLL_LOWER_20D_PCT=ratio(mid - 2 * std, c) - 1,
        BOLL_MID_20D_PCT=ratio(mid, c) - 1,
        BOLL_UPPER_20D_PCT=ratio(mid + 2 * std, c) - 1,
    )


def donchian(b: Board, names) -> None:
    c = b.c
    for w in (20, 60):
        _channel(b, w)
        up, dn = F.col(f"__up{w}"), F.col(f"__dn{w}")
        b.put(2, **{f"DONCHIAN_POSITION_{w}D": ratio(c - dn, up - dn), f"DONCHIAN_WIDTH_{w}D": ratio(up - dn, c)})
    up, dn = F.col("__up20"), F.col("__dn20")
    b.put(
        2,
        DONCHIAN_LOWER_20D_PCT=ratio(dn, c) - 1,
        DONCHIAN_MID_20D_PCT=ratio((up + dn) / 2, c) - 1,
        DONCHIAN_UPPER_20D_PCT=ratio(up, c) - 1,
    )


def asi(b: Board, names) -> None:
    """Swing index: today's move scaled by the largest gap to yesterday."""
    c, h, l, o = b.c, b.h, b.l, b.o  # noqa: E741
    _previous(b)
    b.put(0, __o1=lag(o), __l1=lag(l))
    c1, o1, l1 = F.col("__c1"), F.col("__o1"), F.col("__l1")
    b.put(1, __a=F.abs(h - c1), __b=F.abs(l - c1), __cc=F.abs(h - l1), __d=F.abs(c1 - o1),
          __x=c - c1 + 0.5 * (c - o) + c1 - o1)
    a, bb, cc, d = F.col("__a"), F.col("__b"), F.col("__cc"), F.col("__d")
    reach = (
        F.when((a >= bb) & (a >= cc), a + 0.5 * bb + 0.25 * d)
        .when((bb > a) & (bb >= cc), bb + 0.5 * a + 0.25 * d)
        .otherwise(cc + 0.25 * d)
    )
    b.put(2, __si=50 * ratio(F.col("__x") * F.greatest(a, bb), reach) / 26)
    b.put(3, ASI_26D=_r("__si", 26, 21, F.sum))
    b.put(4, ASIT_26_10=_r("ASI_26D", 10, 8))


def dfma(b: Board, names) -> None:
    c = b.c
    b.put(1, __dfma=_r(c, 10, 8) - _r(c, 50, 40))
    b.put(2, DFMA_DIF_10_50_PCT=ratio("__dfma", c), DFMA_SIGNAL_10_50_10_PCT=ratio(_r("__dfma", 10, 8), c))


def expma(b: Board, names) -> None:
    c = b.c
    for w in (12, 50):
        if f"EXPMA_{w}D_PCT" in names:
            b.average(Step(f"__ema{w}", "__c", w, span=w))
            b.put(LATE, **{f"EXPMA_{w}D_PCT": ratio(f"__ema{w}", c) - 1})


def keltner(b: Board, names) -> None:
    c = b.c
    _true_range(b)
    b.average(Step("__ema20", "__c", 20, span=20))
    b.put(2, __katr=_r("__tr", 10, 8))
    mid, reach = F.col("__ema20"), F.col("__katr")
    b.put(
        LATE,
        KELTNER_LOWER_20_10_PCT=ratio(mid - reach, c) - 1,
        KELTNER_MID_20_10_PCT=ratio(mid, c) - 1,
        KELTNER_UPPER_20_10_PCT=ratio(mid + reach, c) - 1,
    )


BUILDERS = {
    "BIAS": bias, "TRIX": trix, "TRIX_SIGNAL": trix, "RSI": rsi, "KDJ": kdj, "CCI": cci, "OBV": obv, "MAOBV": obv,
    "BBI": bbi, "DPO": dpo, "MADPO": dpo, "ROC": roc, "MAROC": roc, "MTMMA": mtmma, "WR": wr, "PSY": psy, "PSYMA": psy,
    "STREAK": streak, "DAYS_SINCE": days_since, "MASS": mass, "MASS_MA": mass, "MFI": mfi, "VR": vr, "EMV": emv,
    "MAEMV": emv, "AR": ar, "BR": br, "CR": cr, "DMI": dmi, "MACD": macd, "ATR": atr, "BBANDS": bbands, "BOLL": boll,
    "DONCHIAN": donchian, "ASI": asi, "ASIT": asi, "DFMA": dfma, "EXPMA": expma, "KELTNER": keltner,
}


def resolve(name: str) -> str:
    """Canonical output of a name or vendor alias."""
    if name in BLOCKED:
        raise ValueError(f"{name}: no public formula")
    name = ALIASES.get(name, name)
    if name not in GROUP_OF:
        raise KeyError(f"unknown technical factor: {name}")
    return name


def indicators(bars: DataFrame, names: Sequence[str], keep: Sequence[str] = (), at: str | None = None) -> DataFrame:
    """symbol, trade_date, ``keep`` and the named outputs for every bar, or those where the column ``at`` is true.

    All windows run on one shuffle by security; after the averages everything is a step of a row.
    """
    wanted = [resolve(n) for n in names]
    board = Board()
    by_builder: dict = {}
    for name in wanted:
        by_builder.setdefault(BUILDERS[GROUP_OF[name]], set()).add(name)
    for build, asked in by_builder.items():
        build(board, asked)
    price = {"__c": F.col("adj_close"), "__h": F.col("adj_high"), "__l": F.col("adj_low"), "__o": F.col("adj_open")}
    flags = [] if at is None else [at]
    df = bars.select(
        *KEYS, *keep, *flags, *[x.alias(n) for n, x in price.items()], F.nullif(F.col("volume"), F.lit(0.0)).alias("__v")
    )
    early = [n for n in sorted(board.layers) if n <= AVERAGE_LAYER]
    late = [n for n in sorted(board.layers) if n > AVERAGE_LAYER]
    for layer in early:
        df = df.withColumns(board.layers[layer])
    if board.steps:
        needed = _inputs(board, late, wanted, df.columns)
        df = add_averages(df.select(*dict.fromkeys([*KEYS, *keep, *flags, *needed])), list(board.steps.values()), at=at)
    elif at is not None:
        df = df.where(at)
    for layer in late:
        df = df.withColumns(board.layers[layer])
    return df.select(*KEYS, *keep, *[F.col(w).alias(n) for w, n in zip(wanted, names)])


def _inputs(board: Board, late: list[int], wanted: list[str], have: list[str]) -> list[str]:
    """Early columns that the averages, the late layers or the caller read (what crosses to Python)."""
    text = " ".join(str(x) for layer in late for x in board.layers[layer].values())
    read = set(re.findall(r"\w+", text)) | set(wanted)
    for step in board.steps.values():
        read |= set(step.reads)
    return [n for n in have if n in read and n not in KEYS]
