"""Canonical market tables derived from an order-line star schema.

``lineitem`` rows are trades: the supplier is the security and the ship date
the session; the trade price is 20 plus a ten-thousandth of the line's price.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.rolling import frame, running_product
from quantloom.functions.scalar import ratio
from quantloom.operators import asof

PERIODS = {
    "development": ("1995-01-01", "1998-12-31"),
    "validation": ("1999-01-01", "1999-12-31"),
    "test": ("2000-01-01", "2001-12-31"),
}
INDEX_CODE = "TOP_HALF"


def symbol(c: str = "l_suppkey"):
    return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 9, "0"))


def trade_place():
    """Order of trades inside a session as one fixed-width number: order, line (one
    digit), part, price in cents. A struct would force sorting aggregations; a
    decimal keeps them hashed. Trades equal in all four have equal prices."""
    return F.expr(
        "cast(l_orderkey * 10 + l_linenumber as decimal(17, 0)) * cast(1000000000000000000000 as decimal(22, 0))"
        " + cast(l_partkey as decimal(12, 0)) * cast(1000000000 as decimal(10, 0))"
        " + cast(round(l_extendedprice * 100) as decimal(9, 0))"
    )


class Market:
    """Lazy canonical tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def symbols(self) -> int:
        """Number of securities, read from file footers: the most rows a cross-section can hold."""
        return self.table("supplier").count()

    def stored(self) -> Market:
        """The same tables with bars and calendar written once, as a research store would hold them."""
        return self._stored

    @cached_property
    def _stored(self) -> Market:
        from quantloom.session import FIXED, cut, settings

        other = Market(self.spark, self.folder)
        # By security and in time, as every window over them asks; prices that are a product are not written.
        derived = ["adj_open", "adj_high", "adj_low"]
        with settings(self.spark, FIXED):
            kept = cut(self.bars.drop(*derived))
        bars = kept.withColumns({c: F.col(c.removeprefix("adj_")) * F.col("adjust_factor") for c in derived}).select(*self.bars.columns)
        other.__dict__["bars"] = bars
        other.__dict__["daily"] = bars.drop("adjust_factor", "adj_open", "adj_high", "adj_low", "adj_close")
        # Every session with a trade has a bar; one row per session.
        other.__dict__["calendar"] = cut(bars.select("trade_date").distinct().withColumn("is_open", F.lit(True)))
        other.__dict__["_stored"] = other
        return other

    def hot(self, factors: int = 1) -> bool:
        """Whether one cross-section (times factors kept together) may exceed a task."""
        return self.symbols * factors > groups.ROWS_PER_TASK

    @cached_property
    def trades(self) -> DataFrame:
        return self.table("lineitem").withColumns(
            {
                "symbol": symbol(),
                "trade_date": F.to_date("l_shipdate"),
                "price": 20.0 + F.col("l_extendedprice") / 10000.0,
            }
        )

    @cached_property
    def raw_daily(self) -> DataFrame:
        """One bar per security and session. Partial aggregation runs before the
        shuffle, so a security with a third of all trades is no hot task."""
        return self.trades.withColumn("__place", trade_place()).groupBy("symbol", "trade_date").agg(
            F.min_by("price", "__place").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "__place").alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        return self.raw_daily.withColumns(
            {
                "turnover": F.col("volume") / 1000.0,
                "float_market_cap": F.avg("amount").over(frame(60)) * 100.0,
            }
        )

    @cached_property
    def events(self) -> DataFrame:
        """Adjustment events: discounted returned lines of a day, multiplied."""
        picked = self.trades.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09))
        return picked.groupBy("symbol", "trade_date").agg(F.exp(F.sum(F.ln(1 + F.col("l_tax")))).alias("factor"))

    @cached_property
    def adjustments(self) -> DataFrame:
        return self.events.select(
            "trade_date", "symbol", running_product("factor").alias("adjust_factor")
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars with the adjustment in force and adjusted prices."""
        return asof.adjust(self.daily, self.adjustments)

    @cached_property
    def calendar(self) -> DataFrame:
        return self.trades.select("trade_date").distinct().withColumn("is_open", F.lit(True))

    @cached_property
    def securities(self) -> DataFrame:
        first = self.trades.groupBy("symbol").agg(F.min("trade_date").alias("list_date"))
        return (
            self.table("supplier")
            .select(symbol("s_suppkey").alias("symbol"))
            .join(first, "symbol", "left")
            .withColumn(
                "delist_date",
                F.when(F.substring("symbol", -2, 2) == "07", F.lit("2001-06-30").cast("date")),
            )
        )

    @cached_property
    def status(self) -> DataFrame:
        flags = self.trades.groupBy("symbol", "trade_date").agg(
            F.sum("l_quantity").alias("q"),
            F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"),
            F.max("l_discount").alias("d"),
            F.min("l_tax").alias("t"),
        )
        return flags.select(
            "trade_date",
            "symbol",
            ((F.col("returned") == 1) & (F.col("q") >= 45)).alias("is_st"),
            F.lit(False).alias("is_pt"),
            (F.col("q") <= 2).alias("is_suspended"),
            ((F.col("d") >= 0.1) & (F.col("t") >= 0.05)).alias("limit_up"),
            ((F.col("d") <= 0.01) & (F.col("t") >= 0.07)).alias("limit_down"),
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        """Year-to-date disclosures per quarter, 45 days late; some are revised 75 days later."""
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        quarter = self.trades.groupBy(
            "symbol", F.last_day(F.add_months(F.trunc("trade_date", "quarter"), 2)).alias("stat_date")
        ).agg(
            F.sum(net).alias("q_revenue"),
            F.sum(net - F.col("l_extendedprice") * (F.col("l_tax") + 0.6)).alias("q_profit"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_tax")) * 0.3).alias("q_cash"),
            F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"),
        )
        ytd = (
            Window.partitionBy("symbol", F.year("stat_date"))
            .orderBy("stat_date")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        total = Window.partitionBy("symbol").orderBy("stat_date").rowsBetween(Window.unboundedPreceding, 0)
        base = quarter.select(
            "symbol",
            "stat_date",
            "returned",
            F.sum("q_revenue").over(ytd).alias("revenue"),
            F.sum("q_profit").over(ytd).alias("net_profit"),
            F.sum("q_cash").over(ytd).alias("cash"),
            (F.sum("q_profit").over(total) / 1e4 + 100.0).alias("bps"),
        )
        first = base.withColumns({"late": F.lit(45), "scale": F.lit(1.0)})
        revised = base.where(F.col("returned") > 0.4).withColumns({"late": F.lit(120), "scale": F.lit(0.98)})
        return (
            first.unionByName(revised)
            .withColumns(
                {
                    "available_date": F.date_add("stat_date", F.col("late")),
                    "revenue": F.col("revenue") * F.col("scale"),
                    "net_profit": F.col("net_profit") * F.col("scale"),
                }
            )
            .select(
                "symbol",
                "stat_date",
                "available_date",
                "revenue",
                "net_profit",
                (F.col("net_profit") / 1e4).alias("eps"),
                "bps",
                (F.col("cash") / 1e4).alias("ocfps"),
                ratio(F.col("net_profit"), F.col("bps") * 1e4).alias("roe"),
                ratio("net_profit", "revenue").alias("gross_margin"),
            )
        )

    @cached_property
    def industries(self) -> DataFrame:
        """Two industry intervals per security, the class changing at the start of 1999."""
        base = self.table("supplier").select(
            symbol("s_suppkey").alias("symbol"),
            F.explode(
                F.array(
                    F.struct(
                        (F.col("s_nationkey") % 5).alias("k"),
                        F.lit("1990-01-01").cast("date").alias("valid_from"),
                        F.lit("1998-12-31").cast("date").alias("valid_to"),
                    ),
                    F.struct(
                        ((F.col("s_nationkey") + F.col("s_suppkey").cast("int")) % 5).alias("k"),
                        F.lit("1999-01-01").cast("date").alias("valid_from"),
                        F.lit(None).cast("date").alias("valid_to"),
                    ),
                )
            ).alias("i"),
        )
        code = F.concat(F.lit("I"), F.col("i.k").cast("string"))
        return base.select(
            "symbol",
            code.alias("industry_code"),
            F.concat(F.lit("industry "), code).alias("industry_name"),
            "i.valid_from",
            "i.valid_to",
            F.lit("nation").alias("source"),
            F.lit("1").alias("version"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Month-end constituents: securities whose month amount reaches the month's mean."""
        months = self.trades.groupBy(F.trunc("trade_date", "MM").alias("month"), "symbol").agg(
            F.sum("l_extendedprice").alias("amount")
        )
        means = months.groupBy("month").agg(F.avg("amount").alias("mean_amount"))
        last = self.calendar.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(
            F.max("trade_date").alias("snapshot_date")
        )
        return (
            months.join(means, "month")
            .where(F.col("amount") >= F.col("mean_amount"))
            .join(last, "month")
            .select(F.lit(INDEX_CODE).alias("index_code"), "symbol", "snapshot_date", "amount")
        )

    @cached_property
    def index_members(self) -> DataFrame:
        return asof.snapshot_intervals(self.snapshots)

    @cached_property
    def month_ends(self) -> DataFrame:
        """Last session of every calendar month, column ``signal_date``."""
        return asof.month_ends(self.calendar)

    @cached_property
    def month_end_plan(self) -> DataFrame:
        """signal_date, entry_date, exit_date: trade at the next session, leave at the following one."""
        return asof.holding_plan(self.month_ends, self.calendar)

    @cached_property
    def forward(self) -> DataFrame:
        return asof.forward_open_returns(self.bars, self.month_end_plan)

    @cached_property
    def marked_forward(self) -> DataFrame:
        """Monthly forward returns on carried marks, for every security ever quoted."""
        return asof.forward_mark_returns(self.bars, self.month_end_plan, self.calendar)

    @cached_property
    def index_daily(self) -> DataFrame:
        """Index level per session: mean adjusted prices of the securities traded."""
        return self.bars.groupBy("trade_date").agg(
            F.avg("adj_open").alias("open"), F.avg("adj_close").alias("close")
        ).select(F.lit(INDEX_CODE).alias("index_code"), "trade_date", "open", "close")

    @cached_property
    def member_rows(self) -> DataFrame:
        from quantloom.operators.library import member_rows

        return member_rows(self.index_members, self.month_ends, self.securities, self.calendar)
