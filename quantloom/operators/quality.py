"""Data audits: every rule is a row (table, rule, severity, bad_rows)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import asof
from quantloom.sources.tables import KEYS, REQUIRED, write_snapshot

ERROR, WARNING = "error", "warning"


def _rules(df: DataFrame, table: str, rules: Mapping[str, Column], severity: str = ERROR) -> DataFrame:
    """All conditional counts of one table in one pass."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).unpivot([], list(rules), "rule", "bad_rows")
    return counts.select(F.lit(table).alias("table"), "rule", F.lit(severity).alias("severity"), "bad_rows")


def _fixed(spark, table: str, rule: str, severity: str, bad: int) -> DataFrame:
    return spark.range(1).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(bad).cast("long").alias("bad_rows"))


def duplicate_keys(df: DataFrame, table: str, keys: Sequence[str] | None = None) -> DataFrame:
    keys = list(keys or KEYS[table])
    bad = df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("bad_rows"))
    return bad.select(F.lit(table).alias("table"), F.lit("duplicate_key").alias("rule"), F.lit(ERROR).alias("severity"), "bad_rows")


def audit_intervals(df: DataFrame, table: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Reversed intervals, and intervals that start before the previous one of the key ends."""
    w = Window.partitionBy(*keys).orderBy("valid_from")
    nxt = F.lead("valid_from").over(w)
    marked = df.withColumn("__overlap", nxt.isNotNull() & (F.col("valid_to").isNull() | (nxt <= F.col("valid_to"))))
    return _rules(
        marked,
        table,
        {
            "end_before_start": F.col("valid_to") < F.col("valid_from"),
            "overlapping_intervals": F.col("__overlap"),
        },
    )


def missing_columns(tables: Mapping[str, DataFrame]) -> list[tuple[str, list[str]]]:
    return [(n, sorted(set(r) - set(tables[n].columns))) for n, r in REQUIRED.items() if n not in tables or set(r) - set(tables[n].columns)]


def audit(
    tables: Mapping[str, DataFrame], *, index_code: str | None = None, formal: bool = True, metadata: Mapping | None = None,
    history: tuple[str, str] | None = None,
) -> DataFrame:
    """Contract audit of the canonical tables; add ``history`` for the month-end coverage rules."""
    absent = [n for n in REQUIRED if n not in tables]
    if absent:
        raise ValueError(f"missing tables {absent}")
    lacking = missing_columns(tables)
    spark = tables["daily"].sparkSession
    if lacking:
        return reduce(DataFrame.unionByName, [_fixed(spark, n, "missing_columns", ERROR, len(m)) for n, m in lacking])
    daily, members = tables["daily"], tables["index_members"]
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    o, h, l, c = prices  # noqa: E741
    out = [
        _rules(t, n, {"rows": F.lit(True)}, "info") for n, t in tables.items() if n in REQUIRED
    ]
    out += [
        _rules(
            daily,
            "daily",
            {
                "non_positive_price": reduce(lambda a, b: a | b, [p <= 0 for p in prices]),
                "invalid_ohlc": (h < F.greatest(o, c, l)) | (l > F.least(o, c, h)),
                "negative_volume_or_amount": (F.col("volume") < 0) | (F.col("amount") < 0),
            },
        ),
        *[duplicate_keys(tables[n], n) for n in ("daily", "adjustments", "status")],
        _rules(tables["adjustments"], "adjustments", {"factor_not_positive": F.col("adjust_factor") <= 0}),
        audit_intervals(tables["industries"], "industries"),
        audit_intervals(members, "index_members", ("symbol", "index_code")),
        _rules(tables["fundamentals"], "fundamentals", {"no_available_date": F.col("available_date").isNull()}),
    ]
    if index_code is not None:
        chosen = members.where(F.col("index_code") == index_code)
        out.append(_rules(chosen, "index_members", {"missing_weight": F.col("benchmark_weight").isNull(), "negative_weight": F.col("benchmark_weight") < 0}))
        if history is not None:
            out.append(audit_history(tables["calendar"], chosen, tables["industries"], *history))
    metadata = metadata or {}
    for flag, table, rule in (("industry_snapshot_only", "industries", "snapshot_only"), ("benchmark_weights_imputed_equal", "index_members", "imputed_weights")):
        if metadata.get(flag):
            out.append(_fixed(spark, table, rule, ERROR if formal else WARNING, 1))
    return reduce(DataFrame.unionByName, out)


def audit_history(calendar: DataFrame, members: DataFrame, industries: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar reaches both ends; at each month end every member has a weight and an industry."""
    inside = asof.open_dates(calendar).where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    edges = inside.agg(
        (
            F.coalesce((F.min("trade_date") > F.add_months(F.lit(start).cast("date"), 1)), F.lit(True))
            | F.coalesce((F.max("trade_date") < F.add_months(F.lit(end).cast("date"), -1)), F.lit(True))
        ).cast("long").alias("bad_rows")
    ).select(F.lit("calendar").alias("table"), F.lit("incomplete_history").alias("rule"), F.lit(ERROR).alias("severity"), "bad_rows")
    signals = asof.month_ends(inside.withColumn("is_open", F.lit(True)))
    first = members.agg(F.min("valid_from")).scalar()
    signals = signals.where(F.col("signal_date") >= first)
    active = asof.active_on_dates(members, signals, ["symbol", "benchmark_weight"])
    counts = signals.join(active, "signal_date", "left").groupBy("signal_date").agg(F.count("symbol").alias("n"), F.count("benchmark_weight").alias("w"))
    weights = _rules(counts, "index_members", {"dates_without_complete_weights": (F.col("n") == 0) | (F.col("n") != F.col("w"))})
    held = asof.active_on_dates(industries, signals, ["symbol"])
    gaps = active.join(held, ["signal_date", "symbol"], "left_anti").select("signal_date").distinct()
    mapped = _rules(gaps, "industries", {"dates_with_unmapped_members": F.lit(True)})
    return reduce(DataFrame.unionByName, [edges, weights, mapped])


def reassessment(tables: Mapping[str, DataFrame], *, index_code: str = "ALL_A", metadata: Mapping | None = None) -> DataFrame:
    """Provenance issues that block a formal reassessment, as (code, severity, bad_rows)."""
    spark = next(iter(tables.values())).sparkSession
    required = ["daily", "adjustments", "calendar", "fundamentals", "industries", "status"] + (["index_members"] if index_code != "ALL_A" else [])
    parts = [_fixed(spark, n, "MISSING_TABLE", ERROR, 1) for n in required if n not in tables]
    metadata = metadata or {}
    for flag, code in (("industry_snapshot_only", "NON_PIT_INDUSTRY"), ("limit_status_unavailable", "MISSING_PRICE_LIMITS"), ("st_status_unavailable", "MISSING_HISTORICAL_ST")):
        if metadata.get(flag):
            parts.append(_fixed(spark, "metadata", code, ERROR, 1))
    if "industries" in tables:
        code = F.col("industry_code")
        parts.append(_rules(tables["industries"], "industries", {"UNKNOWN_INDUSTRY": code.isNull() | (code == "UNKNOWN") | F.coalesce(F.col("source") == "fallback", F.lit(False))}))
    if "fundamentals" in tables:
        a, s = F.col("available_date"), F.col("stat_date")
        parts.append(_rules(tables["fundamentals"], "fundamentals", {"INVALID_FINANCIAL_AVAILABILITY": a.isNull() | s.isNull() | (a < s)}))
        parts.append(_fixed(spark, "fundamentals", "FINANCIAL_VINTAGES_UNVERIFIED", WARNING, 1))
    if "index_members" in tables:
        stale = stale_intervals(tables["index_members"]).select(
            F.lit("index_members").alias("table"), F.lit("STALE_INDEX_INTERVAL").alias("rule"),
            F.when(F.col("index_code") == index_code, ERROR).otherwise(WARNING).alias("severity"), "bad_rows")
        parts.append(stale)
    return reduce(DataFrame.unionByName, parts)


def stale_intervals(members: DataFrame) -> DataFrame:
    """Per index: intervals that outlive the next complete snapshot."""
    starts = members.select("index_code", "valid_from").distinct()
    nxt = starts.withColumn("__next", F.lead("valid_from").over(Window.partitionBy("index_code").orderBy("valid_from")))
    rows = members.join(nxt, ["index_code", "valid_from"])
    bad = F.col("__next").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("__next")))
    return rows.groupBy("index_code").agg(F.count_if(bad).alias("bad_rows"))


def snapshot_against_intervals(members: DataFrame, date: str) -> DataFrame:
    """Per index: names and weight active on a date against the newest snapshot's."""
    when = F.lit(date).cast("date")
    active = members.where(asof.valid_on(when)).groupBy("index_code").agg(
        F.countDistinct("symbol").alias("interval_count"), F.sum("benchmark_weight").alias("interval_weight"))
    past = members.where(F.col("valid_from") <= when)
    newest = past.groupBy("index_code").agg(F.max("valid_from").alias("valid_from"))
    snap = past.join(newest, ["index_code", "valid_from"]).groupBy("index_code").agg(
        F.countDistinct("symbol").alias("snapshot_count"), F.sum("benchmark_weight").alias("snapshot_weight"))
    return active.join(snap, "index_code", "full_outer")


def audited_snapshot(tables: Mapping[str, DataFrame], root: str, **options) -> DataFrame:
    """Audit the tables and only then write them; returns the manifest."""
    require(audit(tables, **options))
    return write_snapshot(tables, root)


def require(audit_rows: DataFrame) -> DataFrame:
    """Stop when an error rule has bad rows."""
    bad = audit_rows.where((F.col("severity") == ERROR) & (F.col("bad_rows") > 0)).collect()
    if bad:
        raise ValueError("; ".join(f"{r['table']}: {r['rule']} ({r['bad_rows']})" for r in bad))
    return audit_rows


def check_panel(panel: DataFrame, universe: Iterable[str] | None = None) -> DataFrame:
    """A panel has its columns and, when given, exactly the expected factors."""
    needed = {"signal_date", "symbol", "factor_name", "raw_value", "forward_return"}
    missing = sorted(needed - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks {missing}")
    if universe is not None:
        found = {r["factor_name"] for r in panel.select("factor_name").distinct().collect()}
        if found != set(universe):
            raise ValueError(f"panel factors differ: {sorted(found ^ set(universe))}")
    return panel


def check_fields(required: Iterable[str], *frames: DataFrame) -> None:
    have = {c for f in frames for c in f.columns}
    missing = sorted(set(required) - have)
    if missing:
        raise ValueError(f"data lacks fields {missing}")


def run_coverage(panel: DataFrame, run_end: str, days: int = 30, keys: Sequence[str] = ("factor_name",)) -> DataFrame:
    """Whether each factor's last date lies within ``days`` of the run's end."""
    last = panel.groupBy(*keys).agg(F.max("signal_date").alias("last_date"))
    return last.withColumn("covered", F.datediff(F.lit(run_end).cast("date"), "last_date") <= days)


def missing_runs(factors: DataFrame, runs: DataFrame, start: str, end: str) -> DataFrame:
    """Factors whose newest succeeded run does not cover a window."""
    from quantloom.operators.selection import latest_succeeded_runs

    good = latest_succeeded_runs(runs).where((F.col("run_start") <= F.lit(start).cast("date")) & (F.col("run_end") >= F.lit(end).cast("date")))
    return factors.join(good.select("factor_id"), "factor_id", "left_anti")
