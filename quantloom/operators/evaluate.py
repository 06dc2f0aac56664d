"""Factor evaluation: rank IC, quintiles, robust t, turnover, multiple testing.

The panel is shuffled once by (factor, date): ranks of both value columns and
both orientations are windows on those keys, and one aggregation per date
brings everything down to a row. Later steps work on dates, not securities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.scalar import ratio
from quantloom.functions.tails import add_hac_t, benjamini_hochberg, two_sided_p
from quantloom.operators import pit
from quantloom.session import cut

VALUE_TYPES = ("raw", "neutralized")
GROUPS = tuple(f"group_{k}" for k in range(1, 6))
MINIMUM_NAMES = 3


def _variant(n: str, rank: str, back: str, quint: str, sign: float) -> Column:
    """Per-date statistics of one value column in one orientation as a struct aggregate."""
    f = F.col(f"__f_{n}")
    x = F.col(rank) - (F.col(f"__n_{n}") + 1) / 2
    y = F.col(back) - (F.col(f"__n_{n}") + 1) / 2
    ic = ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y)))
    slope = ratio(F.sum(x * f), F.sum(x * x))
    means = [F.avg(F.when(F.col(quint) == k, f)).alias(f"group_{k}") for k in range(1, 6)]
    return F.struct(
        F.lit(n).alias("value_type"),
        F.lit("original" if sign > 0 else "reversed").alias("orientation"),
        (sign * ic).alias("rank_ic"),
        (sign * slope).alias("factor_return"),
        F.count(f).alias("names"),
        (F.count(f) / F.count(F.lit(1))).alias("coverage"),
        *means,
    )


def rank_turnover(panel: DataFrame, value: str, ids: Sequence[str] = ("factor_name",), hot: bool = False) -> DataFrame:
    """Mean change of percentile ranks against the previous signal date, both orientations.

    Only securities valued on both dates count, and the previous date is the
    panel's, not the security's.
    """
    dates = panel.select(*ids, "signal_date").distinct()
    w = Window.partitionBy(*ids).orderBy("signal_date")
    dates = dates.withColumn("__before", F.lag("signal_date").over(w))
    rows = panel.select(*ids, "signal_date", "symbol", F.col(value).alias("__v"))
    rows = groups.ranks(rows, [*ids, "signal_date"], "__v", ["symbol"], average="__r", count="__n", hot=hot)
    rows = rows.select(
        *ids, "signal_date", "symbol", (F.col("__r") / F.col("__n")).alias("__up"),
        ((F.col("__n") + 1 - F.col("__r")) / F.col("__n")).alias("__down"),
    ).join(dates, [*ids, "signal_date"])
    own = Window.partitionBy(*ids, "symbol").orderBy("signal_date")
    adjacent = F.lag("signal_date").over(own) == F.col("__before")
    moved = rows.select(
        *ids,
        "signal_date",
        F.when(adjacent, F.abs(F.col("__up") - F.lag("__up").over(own))).alias("__u"),
        F.when(adjacent, F.abs(F.col("__down") - F.lag("__down").over(own))).alias("__d"),
    )
    return moved.groupBy(*ids, "signal_date").agg(F.avg("__u").alias("original"), F.avg("__d").alias("reversed"))


def monthly_statistics(
    panel: DataFrame,
    ids: Sequence[str] = ("factor_name",),
    periods: Mapping[str, tuple[str, str]] | None = None,
    value_types: Sequence[str] = VALUE_TYPES,
    hot: bool = False,
    turnover: bool = True,
) -> DataFrame:
    """One row per factor, date, value type and orientation."""
    ids = list(ids)
    keys = [*ids, "signal_date"]
    df = panel.select(*keys, "symbol", "forward_return", *[f"{n}_value" for n in value_types])
    for n in value_types:
        both = F.col(f"{n}_value").isNotNull() & F.col("forward_return").isNotNull()
        df = df.withColumns({f"__v_{n}": F.when(both, F.col(f"{n}_value")), f"__f_{n}": F.when(both, F.col("forward_return"))})
        df = groups.ranks(df, keys, f"__v_{n}", ["symbol"], first=f"__up_{n}", average=f"__r_{n}", count=f"__n_{n}", reverse=f"__dn_{n}", hot=hot)
        df = groups.ranks(df, keys, f"__f_{n}", ["symbol"], average=f"__b_{n}", hot=hot)
        df = df.withColumns(
            {
                f"__q_{n}": groups.quintile(f"__up_{n}", f"__n_{n}"),
                f"__p_{n}": groups.quintile(f"__dn_{n}", f"__n_{n}"),
            }
        )
    structs = [
        s
        for n in value_types
        for s in (_variant(n, f"__r_{n}", f"__b_{n}", f"__q_{n}", 1.0), _variant(n, f"__r_{n}", f"__b_{n}", f"__p_{n}", -1.0))
    ]
    table = (
        df.groupBy(*keys)
        .agg(F.array(*structs).alias("__s"))
        .select(*keys, F.inline("__s"))
        .where(F.col("names") >= MINIMUM_NAMES)
        .drop("names")
    )
    if turnover:
        moves = None
        for n in value_types:
            one = rank_turnover(panel, f"{n}_value", ids, hot).select(
                *keys, F.lit(n).alias("value_type"), F.inline(F.array(
                    F.struct(F.lit("original").alias("orientation"), F.col("original").alias("rank_turnover")),
                    F.struct(F.lit("reversed").alias("orientation"), F.col("reversed").alias("rank_turnover")))))
            moves = one if moves is None else moves.unionByName(one)
        table = table.join(moves, [*keys, "value_type", "orientation"], "left")
    table = table.withColumn("group_order", F.lit("descending"))
    return table if periods is None else table.withColumn("period", pit.period("signal_date", dict(periods)))


def monotonicity(means: Sequence[Column]) -> Column:
    """Minus the rank correlation of group number and group mean."""
    ranks = []
    for a in means:
        below = sum(((b < a).cast("int") for b in means), F.lit(0))
        same = sum(((b == a).cast("int") for b in means), F.lit(0))
        ranks.append(below + (same + 1) / 2)
    top = sum(((k - 3) * (r - 3) for k, r in enumerate(ranks, 1)), F.lit(0.0))
    size = sum(((r - 3) * (r - 3) for r in ranks), F.lit(0.0))
    return -ratio(top, F.sqrt(10 * size))


def _series(c: str) -> Column:
    """Non-null values in date order. At most one value per signal date."""
    known = F.when(F.col(c).isNotNull(), F.struct(F.col("signal_date"), F.col(c).alias("x")))
    return F.transform(F.sort_array(F.collect_list(known)), lambda e: e["x"])


def summarise(monthly: DataFrame, keys: Sequence[str], shape: bool = False) -> DataFrame:
    """Mean IC, information ratio, robust t, factor return and coverage per key."""
    keys = list(keys)
    aggregates = [
        F.avg("rank_ic").alias("rank_ic"),
        ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("icir"),
        F.avg("factor_return").alias("fama_macbeth_return"),
        F.avg("coverage").alias("coverage"),
        _series("rank_ic").alias("__ic"),
        _series("factor_return").alias("__fm"),
    ]
    if shape:
        aggregates.append(monotonicity([F.avg(g) for g in GROUPS]).alias("monotonicity"))
    out = monthly.groupBy(*keys).agg(*aggregates)
    out = add_hac_t(add_hac_t(out, "__ic", "hac_t"), "__fm", "fama_macbeth_hac_t").drop("__ic", "__fm")
    return out


def summary_statistics(monthly: DataFrame, ids: Sequence[str] = ("factor_name",)) -> DataFrame:
    """Summary per factor, variant and period, plus the period 'all'."""
    keys = [*ids, "value_type", "orientation"]
    whole = summarise(monthly, keys, shape=True).withColumn("period", F.lit("all"))
    if "period" not in monthly.columns:
        return whole
    parts = summarise(monthly.where(F.col("period").isNotNull()), [*keys, "period"])
    return whole.unionByName(parts, allowMissingColumns=True)


def evaluate_batch(
    panel: DataFrame,
    periods: Mapping[str, tuple[str, str]],
    ids: Sequence[str] = ("factor_name",),
    value_types: Sequence[str] = VALUE_TYPES,
    hot: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Monthly and summary tables of every factor with one correction over the whole batch.

    The monthly rows, a few per factor and date, are stored: the summary reads them several times.
    """
    monthly = cut(monthly_statistics(panel, ids, periods, value_types, hot))
    summary = summary_statistics(monthly, ids).withColumn("p_value", two_sided_p("hac_t"))
    return monthly, benjamini_hochberg(summary, "p_value", "bh_q_value")


def evaluate_indices(
    panel: DataFrame, periods: Mapping[str, tuple[str, str]], value_types: Sequence[str] = VALUE_TYPES, hot: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Every index and factor with one joint correction and a development-only selection family."""
    monthly, summary = evaluate_batch(panel, periods, ["index_code", "factor_name"], value_types, hot)
    chosen = (F.col("period") == "development") & (F.col("value_type") == "raw") & (F.col("orientation") == "original")
    summary = summary.withColumn("__p", F.when(chosen, F.col("p_value")))
    return monthly, benjamini_hochberg(summary, "__p", "development_selection_q_value").drop("__p")


# --- factor by factor matrices --------------------------------------------------------


def ic_matrix(panel: DataFrame, value: str = "raw_value", ids: Sequence[str] = ("factor_name",), hot: bool = False) -> DataFrame:
    """Per date and factor: rank IC over pairs and the slope of return ranks on value ranks.

    Values and returns are ranked over all their own rows; the correlation uses
    the rows that have both.
    """
    keys = [*ids, "signal_date"]
    df = groups.ranks(panel, keys, value, ["symbol"], average="__x", hot=hot)
    df = groups.ranks(df, keys, "forward_return", ["symbol"], average="__y", hot=hot)
    pair = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    df = df.withColumns({"__px": F.when(pair, F.col("__x")), "__py": F.when(pair, F.col("__y"))})
    # ranks are halves, so their sums are exact in any order
    df = groups.stats(df, keys, {"mx": F.avg("__x"), "my": F.avg("__y"), "px": F.avg("__px"), "py": F.avg("__py")}, hot=hot)
    x, y = F.col("__px") - F.col("px"), F.col("__py") - F.col("py")
    cx, cy = F.col("__x") - F.col("mx"), F.col("__y") - F.col("my")
    return df.groupBy(*keys).agg(
        ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("rank_ic"),
        ratio(F.sum(cx * cy), F.sum(cx * cx)).alias("factor_return"),
    )


def correlation_by_date(wide: DataFrame, names: Sequence[str], date: str = "signal_date", hot: bool = False) -> DataFrame:
    """``panel_correlation`` of factor columns, one row per date and symbol."""
    rows = wide.select(date, "symbol", *names).unpivot([date, "symbol"], list(names), "factor_name", "value")
    return panel_correlation(rows, names, date=date, hot=hot)


def panel_correlation(panel: DataFrame, names: Sequence[str], value: str = "value", date: str = "signal_date", hot: bool = False) -> DataFrame:
    """Pairwise rank correlation of factors per date over a long panel: left, right, pairs, correlation.

    Rows are shuffled once, by date: ranks are windows in it, and each date's block becomes one
    matrix of power sums (names x names numbers, whatever the number of securities). With ``hot``, for dates beyond a
    task, ranks come from range-sorted slices and a date's securities are dealt to all
    tasks; their matrices, with the pair counts in them, are added up. No row pairs are formed.
    """
    names = list(names)
    rows = panel.select(date, "symbol", "factor_name", F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & F.col("factor_name").isin(names))
    rows = rows if hot else rows.repartition(date)
    ranked = groups.ranks(rows, [date, "factor_name"], "value", ["symbol"], average="__r", count="__n", hot=hot)
    # centred percentile ranks: the mean rank is known, so sums stay small
    centred = ranked.select(date, "symbol", "factor_name", (F.col("__r") / F.col("__n") - (F.col("__n") + 1) / (2 * F.col("__n"))).alias("p"))
    if hot:
        centred = centred.repartition(date, "symbol")
    sums = power_sums(centred.sortWithinPartitions(date), names, date)
    if hot:
        sums = sums.groupBy(date, "left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    return correlations_of(sums, date)


def power_sums(rows: DataFrame, names: Sequence[str], date: str) -> DataFrame:
    """Per task, date and factor pair: pair count, sums and cross products of ``p`` over securities that have both.

    ``rows`` are sorted by date inside partitions, and one partition holds all rows of a security and date.
    """
    names = list(names)
    place = {n: i for i, n in enumerate(names)}
    left, right = np.triu_indices(len(names))
    pairs = [pa.array([names[i] for i in left]), pa.array([names[j] for j in right])]

    def sums(day, blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(blocks).combine_chunks()
        coded = table["symbol"].combine_chunks().dictionary_encode()
        factors = table["factor_name"].combine_chunks().dictionary_encode()
        columns = np.array([place[f] for f in factors.dictionary.to_pylist()])[factors.indices.to_numpy()]
        x, m = np.zeros((2, len(coded.dictionary) + 1, len(names)))
        # Rows without a symbol share the last place.
        at = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy()
        x[at, columns], m[at, columns] = table["p"].to_numpy(), 1.0
        stats = [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
        days = pa.array([day] * len(left), table.schema.field(date).type)
        return pa.RecordBatch.from_arrays([days, *pairs, *(pa.array(s[left, right]) for s in stats)], names=[date, "left", "right", "n", "x", "y", "xx", "yy", "xy"])

    def run(batches):
        day, held = None, []
        for batch in batches:
            days = batch.column(date)
            turns = np.flatnonzero(np.diff(days.cast(pa.int32()).to_numpy())) + 1
            edges = [0, *turns.tolist(), len(days)] if len(days) else []
            for a, b in zip(edges, edges[1:]):
                if held and days[a].as_py() != day:
                    yield sums(day, held)
                    held = []
                day = days[a].as_py()
                held.append(batch.slice(a, b - a))
        if held:
            yield sums(day, held)

    schema = f"{date} date, left string, right string, n double, x double, y double, xx double, yy double, xy double"
    return rows.select(date, "symbol", "factor_name", "p").mapInArrow(run, schema)


def correlations_of(sums: DataFrame, date: str = "signal_date") -> DataFrame:
    n = F.col("n")
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    vx = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n)
    vy = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)
    value = F.when((vx > 1e-15) & (vy > 1e-15), cov / F.sqrt(vx * vy))
    return sums.select(date, "left", "right", n.cast("long").alias("pairs"), value.alias("correlation"))


def mean_correlation(by_date: DataFrame, minimum_pairs: int = 1, dates: DataFrame | None = None) -> DataFrame:
    """Average over dates of the factor correlation matrix (upper triangle with diagonal)."""
    rows = by_date if dates is None else by_date.join(dates, "signal_date", "left_semi")
    kept = F.when(F.col("pairs") >= minimum_pairs, F.col("correlation"))
    return rows.groupBy("left", "right").agg(F.avg(kept).alias("correlation"))
