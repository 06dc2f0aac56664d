"""Canonical tables: contracts, readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.scalar import day, nested_to_json

# Required columns per canonical table.
REQUIRED: dict[str, tuple[str, ...]] = {
    "daily": ("trade_date", "symbol", "open", "high", "low", "close", "volume", "amount"),
    "adjustments": ("trade_date", "symbol", "adjust_factor"),
    "calendar": ("trade_date", "is_open"),
    "securities": ("symbol", "list_date", "delist_date"),
    "status": ("trade_date", "symbol", "is_st", "is_pt", "is_suspended", "limit_up", "limit_down"),
    "fundamentals": ("symbol", "stat_date", "available_date"),
    "industries": ("symbol", "industry_code", "industry_name", "valid_from", "valid_to", "source", "version"),
    "index_members": ("index_code", "symbol", "valid_from", "valid_to", "benchmark_weight"),
}
# Business key per canonical table.
KEYS: dict[str, tuple[str, ...]] = {
    "daily": ("symbol", "trade_date"),
    "adjustments": ("symbol", "trade_date"),
    "calendar": ("trade_date",),
    "securities": ("symbol",),
    "status": ("symbol", "trade_date"),
    "fundamentals": ("symbol", "stat_date", "available_date"),
    "industries": ("symbol", "valid_from"),
    "index_members": ("index_code", "symbol", "valid_from"),
}
# Vendor column names accepted for canonical ones.
ALIASES = {"date": "trade_date", "code": "symbol", "avail_date": "available_date"}
# Columns of the data contract by kind.
DATE_COLUMNS = ("trade_date", "list_date", "delist_date", "stat_date", "available_date", "valid_from", "valid_to")
FLAG_COLUMNS = ("is_open", "is_st", "is_pt", "is_suspended", "limit_up", "limit_down")
TEXT_COLUMNS = ("symbol", "index_code", "industry_code", "industry_name", "source", "version")
OPTIONAL_DAILY = ("turnover", "float_market_cap")


class ContractError(ValueError):
    """A table breaks its declared contract."""


def column_type(name: str) -> T.DataType:
    if name in DATE_COLUMNS:
        return T.DateType()
    if name in FLAG_COLUMNS:
        return T.BooleanType()
    if name in TEXT_COLUMNS:
        return T.StringType()
    return T.DoubleType()


def empty(spark: SparkSession, table: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, column_type(c)) for c in REQUIRED[table]])
    return spark.createDataFrame([], schema)


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """Refuse an unknown table or missing required columns; extra columns pass."""
    if table not in REQUIRED:
        raise ContractError(f"unknown table {table}; expected one of {sorted(REQUIRED)}")
    missing = sorted(set(REQUIRED[table]) - set(df.columns))
    if missing:
        raise ContractError(f"{table}: missing columns {missing}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Dates to DATE, canonical numbers to double, optional daily columns present."""
    check_columns(df, table)
    casts: dict[str, Column] = {}
    for name in df.columns:
        if name in DATE_COLUMNS:
            casts[name] = day(name)
        elif name in REQUIRED[table] and name not in TEXT_COLUMNS and name not in FLAG_COLUMNS:
            casts[name] = F.col(name).cast("double")
    if table == "daily":
        for name in OPTIONAL_DAILY:
            casts[name] = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
    return df.withColumns(casts)


def import_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan one canonical table from Parquet under its contract."""
    if table not in REQUIRED:
        raise ContractError(f"unknown table {table}; expected one of {sorted(REQUIRED)}")
    return conform(spark.read.parquet(path), table)


def import_rows(spark: SparkSession, path: str, transform=None) -> DataFrame:
    """Generic Parquet import: nested columns become JSON text, then an optional transform."""
    df = nested_to_json(spark.read.parquet(path))
    return df if transform is None else df.transform(transform)


def load_bundle(spark: SparkSession, paths: Mapping[str, str], aliases: Mapping[str, str] = ALIASES) -> dict[str, DataFrame]:
    """Several tables with vendor column names mapped to canonical ones."""
    out = {}
    for table, path in paths.items():
        df = spark.read.parquet(path)
        out[table] = conform(rename_aliases(df, aliases), table)
    return out


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def load_root(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All eight tables under a folder; an absent one is an empty frame."""
    out = {}
    for table in REQUIRED:
        path = f"{root.rstrip('/')}/{table}.parquet"
        out[table] = import_parquet(spark, path, table) if exists(spark, path) else empty(spark, table)
    return out


def write_table(df: DataFrame, path: str, table: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = check_columns(df, table).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or Parquet by suffix."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def write_frame(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """CSV or Parquet by suffix; ``single_file`` only for small reports."""
    df = df.coalesce(1) if single_file else df
    writer = df.write.mode(mode)
    if path.rstrip("/").endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content fingerprint."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"),
    )


def write_snapshot(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Write every table and a manifest of row counts and fingerprints read back from the files."""
    rows: list[DataFrame] = []
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        stored = df.sparkSession.read.parquet(path)
        rows.append(fingerprint(stored).select(F.lit(name).alias("table"), "rows", "content"))
    manifest = reduce(DataFrame.unionByName, rows)
    manifest.write.mode("overwrite").parquet(f"{root.rstrip('/')}/manifest.parquet")
    return manifest


# --- filtered reads -----------------------------------------------------------

_COMPARE = {
    "==": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "not in": lambda c, v: ~c.isin(*v),
}


def filter_column(df: DataFrame, filters: Iterable) -> Column:
    """AND of (column, op, value) triples, or OR of such lists."""
    filters = list(filters)
    if not filters:
        return F.lit(True)
    groups = filters if isinstance(filters[0], list) else [filters]

    def one(triple) -> Column:
        name, op, value = triple
        if name not in df.columns:
            raise ContractError(f"unknown filter column {name}")
        if op not in _COMPARE:
            raise ContractError(f"unknown filter operator {op}")
        return _COMPARE[op](F.col(name), value)

    anded = [reduce(lambda a, b: a & b, [one(t) for t in group]) for group in groups]
    return reduce(lambda a, b: a | b, anded)


def read_table(df: DataFrame, columns: Sequence[str] | None = None, filters: Iterable | None = None) -> DataFrame:
    """Filtered and projected read; both reach the Parquet scan."""
    out = df.where(filter_column(df, filters)) if filters else df
    return out.select(*columns) if columns else out


def padded_range(c: str, start: str, end: str, before: int, after: int) -> Column:
    """c within [start - before days, end + after days], as literals the scan can use."""
    import datetime as dt

    low = dt.date.fromisoformat(start) - dt.timedelta(days=before)
    high = dt.date.fromisoformat(end) + dt.timedelta(days=after)
    return F.col(c).between(F.lit(low), F.lit(high))


def date_bounds(df: DataFrame, c: str = "trade_date") -> DataFrame:
    return df.agg(F.min(c).alias("first_date"), F.max(c).alias("last_date"))


# --- footers --------------------------------------------------------------------

#: Types whose smallest and largest values Parquet footers hold exactly and Spark takes from there.
FOOTER_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)


def footer_summary(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row: ``rows`` and, per column, ``first_`` and ``last_`` value of Parquet files, taken from their footers alone.

    The version 2 reader pushes the aggregates down, so no row is read however large the files
    are. Columns of other types than FOOTER_TYPES are refused: for them rows would be read.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    files = session.read.parquet(path)
    unknown = [c for c in columns if c not in files.columns]
    if unknown:
        raise ContractError(f"unknown columns {unknown}")
    unheld = [c for c in columns if not isinstance(files.schema[c].dataType, FOOTER_TYPES)]
    if unheld:
        raise ContractError(f"footers do not hold bounds of {unheld}")
    bounds = [a for c in columns for a in (F.min(c).alias(f"first_{c}"), F.max(c).alias(f"last_{c}"))]
    return files.agg(F.count(F.lit(1)).alias("rows"), *bounds)
