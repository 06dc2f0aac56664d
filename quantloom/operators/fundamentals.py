"""Disclosure operators: what a company's filings said at each release.

A revision of a fiscal period is known from its release until the period's next revision. It
matters for a shorter time still: until enough newer periods are known for good. ``states``
joins release days with these spans and gives, per release day of a company, the periods that
can matter as one array ordered by period. Its length follows what the operators ask for, not
the number of filings; every operator is an expression on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import prior_year_end, ratio, year_earlier
from quantloom.operators import asof
from quantloom.session import stored


def check_disclosures(fundamentals: DataFrame) -> DataFrame:
    """One row per broken rule: null keys, release before period end, conflicting same-day revisions."""
    keys = ["symbol", "stat_date", "available_date"]
    counts = fundamentals.agg(
        F.count_if(F.col("symbol").isNull() | F.col("stat_date").isNull() | F.col("available_date").isNull()).alias("null_key"),
        F.count_if(F.col("available_date") < F.col("stat_date")).alias("released_before_period_end"),
    ).unpivot([], ["null_key", "released_before_period_end"], "rule", "bad_rows")
    conflicts = fundamentals.distinct().groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("bad_rows"))
    return counts.unionByName(conflicts.select(F.lit("conflicting_revision").alias("rule"), "bad_rows"))


def require_disclosures(fundamentals: DataFrame) -> DataFrame:
    broken = check_disclosures(fundamentals).where("bad_rows > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['bad_rows']} rows" for r in broken))
    return fundamentals


#: Newer periods after which a period matters no more, unless an operator asks for more.
PERIODS = 2
#: Days after which a later period's year-ago and prior year-end dates lie after a period.
BEYOND_A_YEAR = 367


class Needs(NamedTuple):
    """An operator that looks at the last ``periods`` periods with a value."""

    column: Column
    periods: int


def revisions(fundamentals: DataFrame, fields: Sequence[str], periods: int = PERIODS) -> DataFrame:
    """symbol, entry, __from, __until: each revision with the days on which it is its period's newest and can matter.

    A period stops to matter once ``periods`` newer ones, and one more than a year newer, are known with all
    fields that the company ever reports, never to be withdrawn. Companies that leave a field out of
    many periods keep more of them.
    """
    values = F.max(F.struct(*[F.col(f).cast("double").alias(f) for f in fields])).alias("v")
    rows = fundamentals.where("symbol IS NOT NULL AND stat_date IS NOT NULL AND available_date IS NOT NULL")
    rows = rows.groupBy("symbol", "stat_date", "available_date").agg(values)
    company, period = Window.partitionBy("symbol"), Window.partitionBy("symbol", "stat_date")
    reports = [F.max(F.col(f"v.{f}").isNotNull()).over(company) for f in fields]
    whole = reduce(lambda a, b: a & b, [~ever | F.col(f"v.{f}").isNotNull() for f, ever in zip(fields, reports)])
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumns({
        "next": F.lead("available_date").over(period.orderBy("available_date")),
        "torn": F.max(F.when(~F.col("whole"), F.col("available_date"))).over(period),
    })
    for_good = F.min(F.when(F.col("torn").isNull() | (F.col("available_date") > F.col("torn")), F.col("available_date"))).over(period)
    # A period counts once: on its first revision.
    rows = rows.withColumns({"good": for_good, "leads": F.row_number().over(period.orderBy("available_date")) == 1})
    counts = F.col("leads") & F.col("good").isNotNull()
    place = F.count_if(counts).over(company.orderBy("stat_date").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"place": place, "day": -F.unix_date("stat_date"), "last": F.max("available_date").over(company)})
    newer = company.orderBy("place").rangeBetween(1, periods)
    year_newer = company.orderBy("day").rangeBetween(Window.unboundedPreceding, -BEYOND_A_YEAR)
    rows = rows.withColumns({"newer": F.count_if(counts).over(newer), "enough": F.max("good").over(newer), "beyond": F.min("good").over(year_newer)})
    over = F.when((F.col("newer") >= periods) & F.col("beyond").isNotNull(), F.greatest("enough", "beyond"))
    until = F.least(F.date_sub(F.least("next", over), 1), F.col("last"))
    return rows.select("symbol", F.struct("stat_date", "available_date", "v.*").alias("entry"), F.col("available_date").alias("__from"), until.alias("__until"))


def states(fundamentals: DataFrame, fields: Sequence[str], periods: int = PERIODS) -> DataFrame:
    """symbol, available_date, state: the periods that can matter on a release day with their newest revision, oldest period first."""
    spans = stored(revisions(fundamentals, fields, periods), "revisions")
    days = spans.select("symbol", F.col("__from").alias("available_date")).distinct()
    # Spans end with the company's last release day: none is open.
    known = asof.covering(days, spans, ["symbol"], date="available_date", start="__from", end="__until", last=F.lit("9999-12-31").cast("date"), months=12)
    return known.groupBy("symbol", "available_date").agg(F.array_sort(F.collect_list("entry")).alias("state"))


def _with(value: Column, use) -> Column:
    """``use`` of a value computed once per row: a lambda would compute it again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _present(field: str) -> Column:
    return F.filter("state", lambda e: e[field].isNotNull())


def _last(entries: Column, back: int = 1) -> Column:
    return F.try_element_at(entries, F.lit(-back))


def _on(entries: Column, field: str, date: Column) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["stat_date"] == date), F.lit(1))[field]


def latest(field: str) -> Column:
    """The newest period's value, null included."""
    return _last(F.col("state"))[field]


def latest_present(field: str) -> Column:
    return _last(_present(field))[field]


def ttm(field: str) -> Column:
    """Trailing twelve months of year-to-date data; null when a needed period is missing."""

    def year(entries: Column, current: Column) -> Column:
        parts = F.struct(prior_year_end(current["stat_date"]).alias("fy"), year_earlier(current["stat_date"]).alias("same"))
        summed = _with(parts, lambda p: current[field] + _on(entries, field, p["fy"]) - _on(entries, field, p["same"]))
        return F.when(F.month(current["stat_date"]) == 12, current[field]).otherwise(summed)

    return _with(_present(field), lambda entries: _with(_last(entries), lambda current: year(entries, current)))


def yoy(field: str, difference: bool = False) -> Column:
    def change(entries: Column, current: Column) -> Column:
        prior = _with(year_earlier(current["stat_date"]), lambda date: _on(entries, field, date))
        return current[field] - prior if difference else _with(prior, lambda p: ratio(current[field], F.abs(p)) - 1)

    return _with(_present(field), lambda entries: _with(_last(entries), lambda current: change(entries, current)))


def qoq(field: str, difference: bool = False) -> Column:
    """Against the previous available period."""

    def change(entries: Column) -> Column:
        current, prior = _last(entries)[field], _last(entries, 2)[field]
        return current - prior if difference else _with(prior, lambda p: ratio(current, F.abs(p)) - 1)

    return _with(_present(field), change)


def _spread(values: Column, minimum: int) -> Column:
    """Sample standard deviation of array elements."""

    def around(values: Column, mean: Column) -> Column:
        n = F.size(values)
        squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.when(n >= max(minimum, 2), F.sqrt(squares / F.nullif(n - 1, F.lit(0))))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))

    return _with(values, lambda v: _with(mean(v), lambda m: around(v, m)))


def stability(field: str, observations: int, minimum: int, growth: bool = False) -> Needs:
    """Minus the spread of the last N values, or of the changes between them."""

    def tail(values: Column) -> Column:
        return F.slice(values, F.greatest(F.size(values) - observations + 1, F.lit(1)), observations)

    def changes(tail: Column) -> Column:
        before = F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0)))
        after = F.slice(tail, 2, F.greatest(F.size(tail), F.lit(1)))
        return F.filter(F.zip_with(after, before, lambda a, b: ratio(a, b) - 1), lambda x: x.isNotNull())

    values = _with(F.transform(_present(field), lambda e: e[field]), tail)
    return Needs(-_spread(_with(values, changes) if growth else values, minimum), observations)


def events(fundamentals: DataFrame, expressions: dict[str, Column | Needs], fields: Sequence[str]) -> DataFrame:
    """symbol, available_date and named operators after every release day."""
    needs = {n: e if isinstance(e, Needs) else Needs(e, PERIODS) for n, e in expressions.items()}
    known = states(fundamentals, fields, max((e.periods for e in needs.values()), default=PERIODS))
    return known.select("symbol", "available_date", *[e.column.alias(n) for n, e in needs.items()])


REPLAY_FIELDS = ("bps", "revenue", "ocfps", "net_profit", "roe", "gross_margin")


def financial_events(fundamentals: DataFrame) -> DataFrame:
    """Disclosure replay: a late filing updates dependencies, never the newest period; history never changes."""
    return events(
        fundamentals,
        {
            "bps": latest_present("bps"),
            "revenue_ttm": ttm("revenue"),
            "ocfps_ttm": ttm("ocfps"),
            "revenue_yoy": yoy("revenue"),
            "net_profit_yoy": yoy("net_profit"),
            "roe_stability": stability("roe", 8, 6),
            "gross_margin_stability": stability("gross_margin", 8, 6),
        },
        REPLAY_FIELDS,
    )


def attach_events(rows: DataFrame, released: DataFrame, columns: Sequence[str], date: str = "signal_date") -> DataFrame:
    return asof.attach_latest(rows, released, left_time=date, right_time="available_date", columns=list(columns))


def add_financial_features(observations: DataFrame, released: DataFrame) -> DataFrame:
    """Value, stability and growth features at signal dates; needs close and float_market_cap."""
    columns = [c for c in released.columns if c not in ("symbol", "available_date")]
    renamed = released.withColumnsRenamed({c: f"__{c}" for c in columns})
    joined = attach_events(observations, renamed, [f"__{c}" for c in columns])
    return joined.withColumns(
        {
            "BP_MRQ": ratio("__bps", "close"),
            "SP_TTM": ratio("__revenue_ttm", "float_market_cap"),
            "CFP_TTM": ratio("__ocfps_ttm", "close"),
            "ROE_STABILITY_8Q": F.col("__roe_stability"),
            "GROSS_MARGIN_STABILITY_8Q": F.col("__gross_margin_stability"),
            "REVENUE_YOY": F.col("__revenue_yoy"),
            "NET_PROFIT_YOY": F.col("__net_profit_yoy"),
        }
    ).drop(*[f"__{c}" for c in columns])


# --- positional variant ----------------------------------------------------------


def positional_features(fundamentals: DataFrame) -> DataFrame:
    """Features by row position over deduplicated periods: lag 4 for a year, sums of 4 rows for TTM."""
    from quantloom.operators.pit import newest

    rows = newest(fundamentals, ["symbol", "stat_date"], ["available_date"])
    w = Window.partitionBy("symbol").orderBy("stat_date")
    four, eight = w.rowsBetween(-3, 0), w.rowsBetween(-7, 0)
    new = {}
    for field in ("eps", "ocfps"):
        new[f"{field}_yoy"] = ratio(field, F.abs(F.lag(field, 4).over(w))) - 1
    for field in ("roe", "gross_margin"):
        new[f"{field}_yoy_change"] = F.col(field) - F.lag(field, 4).over(w)
        new[f"{field}_stability"] = F.when(F.count(field).over(eight) >= 6, -F.stddev_samp(field).over(eight))
    for field in ("eps", "ocfps", "net_profit", "revenue"):
        new[f"{field}_ttm"] = F.when(F.count(field).over(four) >= 4, F.sum(field).over(four))
    new["__growth"] = ratio("net_profit", F.lag("net_profit", 1).over(w)) - 1
    rows = rows.withColumns(new)
    return rows.withColumns(
        {
            "net_margin_ttm": ratio("net_profit_ttm", "revenue_ttm"),
            "ocf_to_earnings": ratio("ocfps_ttm", "eps_ttm"),
            "earnings_growth_stability": F.when(F.count("__growth").over(eight) >= 6, -F.stddev_samp("__growth").over(eight)),
        }
    ).drop("__growth")


# Panel factor to positional column; the first three are divided by the raw close.
PANEL_FIELDS = {
    "EP_TTM": "eps_ttm",
    "BP_MRQ": "bps",
    "CFP_TTM": "ocfps_ttm",
    "EPS_YOY": "eps_yoy",
    "OCFPS_YOY": "ocfps_yoy",
    "ROE_YOY_CHANGE": "roe_yoy_change",
    "GROSS_MARGIN_YOY_CHANGE": "gross_margin_yoy_change",
    "ROE": "roe",
    "GROSS_MARGIN": "gross_margin",
    "NET_MARGIN_TTM": "net_margin_ttm",
    "OCF_TO_EARNINGS": "ocf_to_earnings",
    "ROE_STABILITY_8Q": "roe_stability",
    "GROSS_MARGIN_STABILITY_8Q": "gross_margin_stability",
    "EARNINGS_GROWTH_STABILITY_8Q": "earnings_growth_stability",
}
PER_PRICE = ("EP_TTM", "BP_MRQ", "CFP_TTM")
VENDOR_GROWTH = {"REVENUE_YOY": "rev_yoy", "NET_PROFIT_YOY": "np_yoy"}


def latest_period(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per release day, the newest period known so far (a late older filing does not replace it)."""
    w = Window.partitionBy("symbol").orderBy("available_date").rangeBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("stat_date", "available_date", *columns)).over(w)
    return features.select("symbol", "available_date", best.alias("__best")).dropDuplicates(["symbol", "available_date"]).select(
        "symbol", "available_date", *[F.col(f"__best.{c}").alias(c) for c in columns]
    )


def panel_factors(members: DataFrame, fundamentals: DataFrame, price: str = "raw_close") -> DataFrame:
    """Attach the latest visible period's factors to (signal_date, symbol) rows."""
    features = positional_features(fundamentals)
    fields = dict(PANEL_FIELDS) | {k: v for k, v in VENDOR_GROWTH.items() if v in features.columns}
    known = latest_period(features, list(dict.fromkeys(fields.values())))
    renamed = known.withColumnsRenamed({c: f"__f_{c}" for c in set(fields.values())})
    joined = attach_events(members, renamed, [f"__f_{c}" for c in dict.fromkeys(fields.values())])
    out = {n: ratio(f"__f_{f}", price) if n in PER_PRICE else F.col(f"__f_{f}") for n, f in fields.items()}
    return joined.withColumns(out).drop(*[f"__f_{c}" for c in set(fields.values())])
