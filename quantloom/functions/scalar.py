"""Scalar column helpers: guards, codes, dates, fees."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """top / bottom, null when bottom is 0 (or null)."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def finite(c: str | Column) -> Column:
    """Null instead of NaN or an infinity."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def number(c: str | Column) -> Column:
    """Text or number to double; what does not parse becomes null."""
    return finite(col(c).try_cast("double"))


def at_least(c: str | Column, low: Column | float) -> Column:
    """Lower clamp that keeps nulls (``greatest`` alone would drop them)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(float(low))
    return F.when(c < low, low).otherwise(c)


def at_most(c: str | Column, high: Column | float) -> Column:
    c = col(c)
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c > high, high).otherwise(c)


def clip(c: str | Column, low=None, high=None) -> Column:
    c = col(c)
    if low is not None:
        c = at_least(c, low)
    return c if high is None else at_most(c, high)


def log(c: str | Column) -> Column:
    """Natural logarithm; null outside the domain."""
    c = col(c).cast("double")
    return F.when(c > 0, F.ln(c))


def power(c: str | Column, exponent) -> Column:
    return finite(F.pow(col(c).cast("double"), exponent if isinstance(exponent, Column) else F.lit(float(exponent))))


# --- codes -----------------------------------------------------------------

# Exchange suffixes by leading digits of a bare six-digit code.
SHANGHAI_LEADS = ("5", "6", "9")
BEIJING_LEADS = ("4", "8")
# Share prefixes listed per exchange.
SHARE_PREFIXES = {
    "SH": ("600", "601", "603", "605", "688", "689"),
    "SZ": ("000", "001", "002", "003", "300", "301"),
    "BJ": ("4", "8"),
}
# Prefixes of foreign-currency share classes.
FOREIGN_PREFIXES = ("200", "900")


def security_code(c: str | Column) -> Column:
    """``sh.600000``, ``600000.SH`` or ``600000`` as ``600000.SH``; anything else fails."""
    text = F.trim(col(c).cast("string"))
    lead = F.substring(text, 1, 1)
    exchange = (
        F.when(lead.isin(*SHANGHAI_LEADS), F.lit("SH")).when(lead.isin(*BEIJING_LEADS), F.lit("BJ")).otherwise(F.lit("SZ"))
    )
    return (
        F.when(text.rlike(r"^..\..{6}$"), F.concat(F.substring(text, 4, 6), F.lit("."), F.upper(F.substring(text, 1, 2))))
        .when(text.rlike(r"^.{6}\..{2}$"), F.concat(F.substring(text, 1, 7), F.upper(F.substring(text, 8, 2))))
        .when(text.rlike(r"^[0-9]{6}$"), F.concat(text, F.lit("."), exchange))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported security code: "), F.coalesce(text, F.lit("null")))).cast("string"))
    )


def listed_share(number_col: str | Column, exchange_col: str | Column) -> Column:
    """True for a six-digit number with a share prefix of its exchange."""
    num, exchange = col(number_col), col(exchange_col)
    known = F.lit(False)
    for name, prefixes in SHARE_PREFIXES.items():
        starts = F.lit(False)
        for prefix in prefixes:
            starts = starts | num.startswith(prefix)
        known = known | ((exchange == name) & starts)
    return num.rlike(r"^[0-9]{6}$") & known


def domestic_code(c: str | Column) -> Column:
    """True for ``dddddd.EX`` codes other than foreign-currency classes."""
    c = col(c)
    return F.coalesce(
        c.rlike(r"^[0-9]{6}\.(SH|SZ|BJ)$") & ~F.substring(c, 1, 3).isin(*FOREIGN_PREFIXES), F.lit(False)
    )


# --- dates -----------------------------------------------------------------


def day(c: str | Column) -> Column:
    """Any date, timestamp or parsable text as a DATE; null when it does not parse."""
    return col(c).try_cast("date")


def parse_day(c: str | Column) -> Column:
    """Vendor text as a DATE: ISO forms or eight digits; null when neither."""
    c = col(c)
    return F.coalesce(c.try_cast("date"), F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date"))


def local_day(c: str | Column, unit: str = "s", zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds or milliseconds as the calendar day in ``zone``."""
    stamp = F.timestamp_seconds(col(c)) if unit == "s" else F.timestamp_millis(col(c))
    # to_utc_timestamp/from_utc_timestamp act on the wall clock, so the session zone cancels out.
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), stamp.cast("timestamp_ntz")))


def friday_week(c: str | Column) -> Column:
    """The Friday that closes the week of a date (weeks run Saturday to Friday)."""
    return F.date_sub(F.next_day(col(c), "Sat"), 1)


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def period_key(c: str | Column, frequency: str) -> Column:
    """Closing calendar day of the period that holds a date: W-FRI, M, Q or Y."""
    c = col(c)
    if frequency == "W-FRI":
        return friday_week(c)
    if frequency == "M":
        return F.last_day(c)
    if frequency == "Q":
        return F.last_day(F.add_months(F.trunc(c, "quarter"), 2))
    if frequency == "Y":
        return F.make_date(F.year(c), F.lit(12), F.lit(31))
    raise ValueError(f"frequency must be W-FRI, M, Q or Y, got {frequency}")


def year_earlier(c: str | Column) -> Column:
    """Same calendar day one year before (29 February becomes 28)."""
    return F.add_months(col(c), -12)


def prior_year_end(c: str | Column) -> Column:
    return F.make_date(F.year(col(c)) - 1, F.lit(12), F.lit(31))


# --- fees ------------------------------------------------------------------

# Commission in basis points; statutory rates with the day each lower rate starts.
COMMISSION_BPS = 3.0
STAMP_TAX = (0.001, dt.date(2023, 8, 28), 0.0005)
TRANSFER_FEE = (0.00002, dt.date(2022, 4, 29), 0.00001)
# One-way slippage of the layer cost diagnostics (base, stressed).
LAYER_SLIPPAGE = (0.0005, 0.0010)


def _rate(when: Column, schedule: tuple) -> Column:
    before, switch, after = schedule
    return F.when(when >= F.lit(switch), F.lit(after)).otherwise(F.lit(before))


def fee_rates(
    when: str | Column, side: str | Column, *, commission_bps: float = COMMISSION_BPS, statutory: bool = True
) -> dict[str, Column]:
    """Commission, stamp tax (sales only) and transfer fee rates on a day."""
    when, side = col(when), col(side)
    zero = F.lit(0.0)
    return {
        "commission": F.lit(commission_bps / 10_000),
        "stamp_tax": F.when(side == "buy", zero).otherwise(_rate(when, STAMP_TAX)) if statutory else zero,
        "transfer_fee": _rate(when, TRANSFER_FEE) if statutory else zero,
    }


def fees(
    when: str | Column,
    side: str | Column,
    notional: str | Column,
    *,
    commission_bps: float = COMMISSION_BPS,
    minimum_commission: float = 0.0,
    statutory: bool = True,
) -> dict[str, Column]:
    """Fee amounts of one trade."""
    notional = col(notional)
    rates = fee_rates(when, side, commission_bps=commission_bps, statutory=statutory)
    return {
        "commission": F.greatest(F.lit(float(minimum_commission)), notional * rates["commission"]),
        "stamp_tax": notional * rates["stamp_tax"],
        "transfer_fee": notional * rates["transfer_fee"],
    }


def turnover_cost(when: str | Column, buys: str | Column, sells: str | Column) -> tuple[Column, Column]:
    """(base, stressed) cost of buying and selling given fractions of the portfolio."""
    when, buys, sells = col(when), col(buys), col(sells)
    shared = F.lit(COMMISSION_BPS / 10_000) + _rate(when, TRANSFER_FEE)
    stamp = sells * _rate(when, STAMP_TAX)
    base, stressed = LAYER_SLIPPAGE
    return (buys + sells) * (shared + base) + stamp, (buys + sells) * (shared + stressed) + stamp


# --- text and hashes ---------------------------------------------------------


def nested_to_json(df):
    """Array, map, struct and void columns as JSON text (interchange form)."""
    from pyspark.sql import types as T

    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(field.name)).alias(field.name))
        elif isinstance(field.dataType, T.NullType):
            out.append(F.col(field.name).cast("string").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def digest(*columns: str | Column) -> Column:
    """SHA-256 of the columns joined with a separator; nulls keep their place."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)
