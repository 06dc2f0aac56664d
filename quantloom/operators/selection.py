"""Choosing factors, methods, names and rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups

SELECTION_PERIODS = ("development", "validation")
_COMPARE = {
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def latest_succeeded_runs(runs: DataFrame) -> DataFrame:
    """Newest succeeded run per factor."""
    rest = [c for c in runs.columns if c != "factor_id"]
    best = F.max_by(F.struct(*rest), F.struct("created_at", "run_id")).alias("__r")
    return runs.where(F.col("status") == "succeeded").groupBy("factor_id").agg(best).select("factor_id", "__r.*")


def metric_lookup(metrics: DataFrame, index_code: str) -> DataFrame:
    """One value per (factor, metric, period, orientation): the index's own, else ALL_A's."""
    usable = metrics.where(F.col("index_code").isin(index_code, "ALL_A") & F.col("metric_value").isNotNull())
    return usable.groupBy("factor_id", "metric_name", "period", "orientation").agg(
        F.max_by("metric_value", (F.col("index_code") == index_code).cast("int")).alias("metric_value")
    )


def resolve(
    factors: DataFrame,
    metrics: DataFrame,
    *,
    families: Sequence[str] = (),
    rules: Sequence[Mapping] = (),
    sort_by: Mapping | None = None,
    top_n: int | None = None,
    direction: str = "abs",
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    index_code: str = "ALL_A",
) -> DataFrame:
    """Factors of some families that pass metric rules, the best N of them, plus explicit includes.

    A rule is {metric, period, orientation, op, value}; only development and
    validation figures may select.
    """
    for rule in [*rules, *([sort_by] if sort_by else [])]:
        if rule["period"] not in SELECTION_PERIODS:
            raise ValueError(f"selection may only use {SELECTION_PERIODS}, got {rule['period']}")
    values = metric_lookup(metrics, index_code)

    def value_of(rule: Mapping) -> DataFrame:
        return values.where(
            (F.col("metric_name") == rule["metric"]) & (F.col("period") == rule["period"])
            & (F.col("orientation") == rule.get("orientation", "original"))
        ).select("factor_id", F.col("metric_value").alias("__m"))

    explicit = F.col("factor_id").isin(*include) if include else F.lit(False)
    pool = factors.where(~F.col("factor_id").isin(*exclude)) if exclude else factors
    kept = pool.where(F.col("family").isin(*families)) if families else pool.where(F.lit(bool(rules or sort_by)))
    kept = kept.where(~explicit)
    for rule in rules:
        passed = value_of(rule).where(_COMPARE[rule["op"]](F.col("__m"), F.lit(rule["value"])))
        kept = kept.join(passed.select("factor_id"), "factor_id", "left_semi")
    if sort_by and top_n:
        m = F.col("__m")
        order = {"abs": F.abs(m).desc_nulls_last(), "desc": m.desc_nulls_last(), "asc": m.asc_nulls_last()}[direction]
        kept = kept.join(value_of(sort_by), "factor_id", "left").orderBy(order, "factor_id").limit(top_n).drop("__m")
    return kept.unionByName(pool.where(explicit)).dropDuplicates(["factor_id"])


def top_names(
    scores: DataFrame, n: int, keys: Sequence[str] = ("signal_date",), score: str = "score", reserve: float = 0.0, hot: bool = False
) -> DataFrame:
    """The n best scores per date with equal weights of (1 - reserve)."""
    rows = groups.ranks(scores.where(F.col(score).isNotNull()), keys, score, ["symbol"], first="place", descending=True, hot=hot)
    rows = rows.where(F.col("place") <= n)
    # at most n rows per date are left
    return rows.withColumn("target_weight", F.lit(1.0 - reserve) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def development_factors(
    summary: DataFrame, signs: DataFrame, hypotheses: DataFrame | None = None, *, significant: bool = True,
    minimum_coverage: float = 0.5, level: float = 0.10,
) -> DataFrame:
    """Factors with positive aligned development IC, coverage and corrected significance; one per hypothesis if given."""
    rows = development_rows(summary).join(signs, ["index_code", "factor_name"])
    rows = rows.withColumn("aligned_ic", F.col("rank_ic") * F.col("sign"))
    keep = (F.col("aligned_ic") > 0) & (F.col("coverage") >= minimum_coverage)
    if significant:
        keep = keep & (F.col("development_selection_q_value") < level)
    rows = rows.where(keep)
    if hypotheses is not None:
        w = Window.partitionBy("index_code", "hypothesis").orderBy(F.desc("aligned_ic"), F.desc("coverage"), "factor_name")
        rows = rows.join(hypotheses, "factor_name").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return rows.select("index_code", "factor_name", "aligned_ic", "coverage")


def development_rows(summary: DataFrame) -> DataFrame:
    return summary.where((F.col("period") == "development") & (F.col("value_type") == "raw") & (F.col("orientation") == "original"))


def locked_signs(summary: DataFrame, directions: DataFrame) -> DataFrame:
    """+1 or -1 per index and factor: the registered direction, or the development IC's sign when unknown."""
    seen = summary.select("index_code", "factor_name").distinct()
    ic = development_rows(summary).groupBy("index_code", "factor_name").agg(F.first("rank_ic").alias("__ic"))
    joined = seen.join(directions, "factor_name").join(ic, ["index_code", "factor_name"], "left")
    sign = F.when(F.col("direction") == "negative", -1.0).when(F.col("direction") == "positive", 1.0).otherwise(
        F.when(F.col("__ic") < 0, -1.0).otherwise(1.0)
    )
    return joined.select("index_code", "factor_name", sign.alias("sign"))


def low_correlation(correlation: DataFrame, priority: DataFrame, names: Sequence[str], threshold: float = 0.80) -> list[str]:
    """Keep the strongest factor of every highly correlated set.

    The matrix is factors x factors (a few hundred names), computed by Spark;
    the order-dependent scan over it runs here.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    close: dict[str, set[str]] = {}
    for row in correlation.where(F.abs("correlation") >= threshold).select("left", "right").collect():
        close.setdefault(row["left"], set()).add(row["right"])
        close.setdefault(row["right"], set()).add(row["left"])
    strength = {r["factor_name"]: abs(r["priority"]) for r in priority.collect() if r["priority"] is not None}
    ordered = sorted(names, key=lambda n: (-strength.get(n, float("-inf")), list(names).index(n)))
    kept: list[str] = []
    for name in ordered:
        if not any(other in close.get(name, ()) for other in kept):
            kept.append(name)
    return kept


def validation_method(metrics: DataFrame, keys: Sequence[str] = (), slack: float = 0.05) -> DataFrame:
    """Per key the lowest-turnover method within ``slack`` of the best information ratio."""
    parts = [F.col(k) for k in keys] or [F.lit(0)]
    best = F.max("net_information_ratio").over(Window.partitionBy(*parts))
    close = metrics.withColumn("__best", best).where(F.col("net_information_ratio") >= F.col("__best") - slack)
    w = Window.partitionBy(*parts).orderBy("turnover", "method")
    return close.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__best")


def best_by(df: DataFrame, keys: Sequence[str], value: str, order: str, tie: str) -> DataFrame:
    """The ``value`` with the largest ``order`` per key."""
    known = df.where(F.col(order).isNotNull())
    pick = F.min_by(value, F.struct(-F.col(order), F.col(tie))).alias(value)
    return known.groupBy(*keys).agg(pick, F.max(order).alias(order))


def consistent_factors(summary: DataFrame, n: int = 10, keys: Sequence[str] = ("index_code",)) -> DataFrame:
    """Report table: per index the n factors with the largest smaller of development and validation IC."""
    wide = summary.groupBy(*keys, "factor_name").pivot("period", ["development", "validation"]).agg(F.first("rank_ic"))
    weakest = F.when(F.col("development").isNotNull() & F.col("validation").isNotNull(), F.least("development", "validation"))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("weakest_ic"), "factor_name")
    return wide.withColumn("weakest_ic", weakest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def keyed_sample(df: DataFrame, share: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, chosen by a hash of seed and keys: the same on every run,
    in one pass, and growing with the input."""
    text = F.concat_ws("|", F.lit(str(seed)), *keys)
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.where(draw < int(share * 2**32))


FAMILY_ORDER = ("value", "growth", "momentum", "liquidity", "risk", "quality", "technical")


def in_family_order(factors: DataFrame) -> DataFrame:
    place = F.lit(len(FAMILY_ORDER))
    for i, family in enumerate(FAMILY_ORDER):
        place = F.when(F.col("family") == family, i).otherwise(place)
    return factors.orderBy(place, "factor_name")


def family_leaders(factors: DataFrame, n: int, minimum: int = 2, keys: Sequence[str] = ("index_code",)) -> DataFrame:
    """Per index the n strongest factors of every family by absolute validation IC; small families are skipped.

    Sizes are partial counts, and the limit on places cuts every task's rows before the shuffle.
    """
    family = [*keys, "family"]
    w = Window.partitionBy(*family).orderBy(F.abs("rank_ic").desc_nulls_last(), "factor_name")
    leaders = factors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    large = factors.groupBy(*[F.col(k).alias(f"__{k}") for k in family]).count().where(F.col("count") >= minimum)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in family])
    return leaders.join(large, same, "left_semi")


def check_isolation(rows: DataFrame, test_start: str, date: str = "signal_date") -> None:
    """Training and selection rows must lie before the test period."""
    if not rows.where(F.col(date) >= F.lit(test_start).cast("date")).isEmpty():
        raise ValueError("test observations cannot select direction, factors or parameters")
