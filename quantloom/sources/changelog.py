"""Append-only change log: versioned reads, key upserts, schema growth.

A log row carries ``_version`` (publication), ``_row`` (order inside it) and
``_mode`` ('replace' starts a new generation, 'upsert' adds to it). The order
comes from a column of the data, so any layout of the same rows reads the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.sources.tables import ContractError, filter_column

META = ("_version", "_row", "_mode")
MODES = ("append", "replace", "upsert")


def check_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys exist, column names are unique, and no key is null."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ContractError(f"missing key columns {missing}")
    if len(set(df.columns)) != len(df.columns):
        raise ContractError("duplicate column names")
    bad = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first()
    null_keys = [k for k in keys if bad[k]]
    if null_keys:
        raise ContractError(f"null keys in {null_keys}")
    return df


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key column: number of nulls."""
    counts = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
    return counts.unpivot([], list(keys), "key_column", "null_rows")


def stamp(df: DataFrame, version: int, mode: str, sequence: str | None = None) -> DataFrame:
    """Rows ready to append as one publication; the whole-number column ``sequence`` orders repeated keys."""
    row = F.lit(0) if sequence is None else F.col(sequence)
    return df.withColumns({"_version": F.lit(version).cast("long"), "_row": row.cast("long"), "_mode": F.lit(mode)})


def check_order(stamped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refuse different rows of one publication that share their keys and place."""
    data = [c for c in stamped.columns if c not in META and c not in keys]
    if data:
        content = F.xxhash64(*data)
        spread = stamped.groupBy(*keys, "_row").agg(F.min(content).alias("least"), F.max(content).alias("most"))
        if not spread.where("least <> most").isEmpty():
            raise ContractError(f"rows repeat {list(keys)} without an order; name a sequence column")
    return stamped


def write_version(stamped: DataFrame, keys: Sequence[str], path: str) -> None:
    """Check the rows of one publication and write them to a folder of their own."""
    stamped = stamped.drop("_version").persist()
    try:
        check_order(check_keys(stamped, keys), keys)
        stamped.write.mode("errorifexists").parquet(path)
    finally:
        stamped.unpersist()


@dataclass(frozen=True)
class Commit:
    """One entry of the manifest: a publication (``base`` false) or the compacted rows of a version."""

    version: int
    mode: str
    path: str
    fields: str
    batch: str | None = None
    through: str | None = None
    base: bool = False
    buckets: int | None = None
    order: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.fields))


COMMIT = "version long, mode string, path string, fields string, batch string, through string, base boolean, buckets int, order string"
ORDERS = {"version": ("_version", "_row"), "sequence": ("_row", "_version")}


class Log:
    """A change log in a folder: data folders, and a manifest entry for each that counts.

    Data are written first, under a name of their own; the entry follows, in a file named by the
    version and created only if there is none. What has no entry was never published: a writer
    that dies leaves nothing behind that anyone reads, of two that meet one is refused, and
    versions published before are never touched. An entry may name the ``batch`` it came from, so
    that a replay finds it done, and how far its source is read ``through``: data and
    progress become visible together.

    ``compact`` writes the live rows of a version bucketed by key. Reads from that version on open
    the buckets and later publications only, and shuffle only the latter.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- manifest ---

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[Commit]:
        """All publications, by version."""
        return [c for c in self._entries() if not c.base]

    def _entries(self) -> list[Commit]:
        folder = f"{self.folder}/commits"
        path, fs = self._path(folder)
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema(COMMIT).json(folder).orderBy("version").collect()
        return [Commit(**r.asDict()) for r in rows]

    def _commit(self, name: str, entry: Commit) -> None:
        path, fs = self._path(f"{self.folder}/commits/{name}.json")
        # A temporary name first: readers never see half an entry, and a rename does not replace one.
        part, _ = self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(asdict(entry)).encode()))
        finally:
            out.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        rename = getattr(hadoop, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, path, options)
        except Py4JJavaError as e:
            fs.delete(part, False)
            if not fs.exists(path):
                raise
            raise ContractError(f"version {entry.version} was published by another writer") from e

    @property
    def version(self) -> int:
        """The newest version, -1 if there is none."""
        return max((c.version for c in self.commits()), default=-1)

    @property
    def through(self) -> str | None:
        """How far the newest publication with such a mark has read its source."""
        return next((c.through for c in reversed(self.commits()) if c.through is not None), None)

    # --- writing ---

    def publish(self, rows: DataFrame, keys: Sequence[str], mode: str = "upsert", sequence: str | None = None, batch: str | None = None, through: str | None = None) -> int:
        """Write ``rows`` as the next version; returns the version.

        'replace' starts a new generation, with 'upsert' newer rows win, 'append' refuses keys
        that are live. A ``batch`` that is published already is left as it is.
        """
        if mode not in MODES:
            raise ContractError(f"unknown mode {mode}; expected one of {MODES}")
        commits = self.commits()
        done = next((c for c in commits if batch is not None and c.batch == batch), None)
        if done is not None:
            return done.version
        version = max((c.version for c in commits), default=-1) + 1
        if commits and mode != "replace":
            self._check_growth(commits, rows)
            if mode == "append" and not rows.join(self.read(keys, columns=list(keys)), list(keys), "left_semi").isEmpty():
                raise ContractError(f"append would repeat live {list(keys)}")
        stamped = stamp(rows, version, "replace" if mode == "replace" else "upsert", sequence)
        path = f"data/_version={version}/_attempt={uuid.uuid4().hex}"
        write_version(stamped, keys, f"{self.folder}/{path}")
        self._commit(f"{version:012d}", Commit(version, "replace" if mode == "replace" else "upsert", path, rows.schema.json(), batch, through))
        return version

    def _check_growth(self, commits: Sequence[Commit], rows: DataFrame) -> None:
        known, given = self._schema(commits), rows.schema
        lost = set(known.names) - set(given.names)
        if lost:
            raise ContractError(f"columns cannot be dropped: {sorted(lost)}")
        changed = [f.name for f in known if given[f.name].dataType != f.dataType]
        if changed:
            raise ContractError(f"columns cannot change their type: {changed}")

    @staticmethod
    def _schema(commits: Sequence[Commit]) -> T.StructType:
        """Columns of the publications since the last replacement, all of them nullable."""
        start = max((i for i, c in enumerate(commits) if c.mode == "replace"), default=0)
        fields = {f.name: T.StructField(f.name, f.dataType) for c in commits[start:] for f in c.schema}
        return T.StructType(list(fields.values()))

    # --- reading ---

    def rows(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Stamped rows of the publications later than ``after``, up to ``upto``; columns that came later are null in older rows."""
        commits = [c for c in self.commits() if upto is None or c.version <= upto]
        if not commits:
            raise ContractError(f"nothing published in {self.folder}")
        meta = T.StructType.fromDDL("_row long, _mode string")
        columns = T.StructType([*self._schema(commits), *meta])
        chosen = [c for c in commits if c.version > after]
        if not chosen:
            return self.spark.createDataFrame([], columns).withColumn("_version", F.lit(0).cast("long"))
        reader = self.spark.read.schema(columns).option("basePath", f"{self.folder}/data")
        found = reader.parquet(*[f"{self.folder}/{c.path}" for c in chosen])
        return found.withColumn("_version", F.col("_version").cast("long")).drop("_attempt")

    def read(self, keys: Sequence[str], *, as_of: int | None = None, columns: Sequence[str] | None = None, filters: Iterable | None = None, by: Sequence[str] = ORDERS["version"]) -> DataFrame:
        """Newest row per key up to version ``as_of``, as ``changelog.read`` gives it."""
        entries = [c for c in self._entries() if as_of is None or c.version <= as_of]
        start = max((c.version for c in entries if c.mode == "replace" and not c.base), default=0)
        bases = [c for c in entries if c.base and c.version >= start and tuple(by) == ORDERS.get(c.order)]
        if not bases:
            return read(self.rows(start - 1, as_of), keys, columns=columns, filters=filters, by=by)
        base = bases[-1]
        later = self.rows(base.version, as_of)
        early, late = split_filters(filters, keys)
        old, new = self._buckets(base, keys), later
        if early:
            old, new = old.where(filter_column(old, early)), new.where(filter_column(new, early))
        data = [c for c in later.columns if c not in META and c not in keys]
        held = [F.col(c) if c in old.columns else F.lit(None).cast(later.schema[c].dataType).alias(c) for c in data]
        old = old.select(*keys, F.struct(*held, *by).alias("__old"))
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*data, *by), F.struct(*by)).alias("__new"))
        place = lambda c: F.struct(*[F.col(f"{c}.{b}") for b in by])
        newer = F.col("__old").isNull() | (F.col("__new").isNotNull() & (place("__new") > place("__old")))
        live = old.join(new, list(keys), "full").withColumn("__newest", F.when(newer, F.col("__new")).otherwise(F.col("__old")))
        live = live.select(*keys, *[F.col(f"__newest.{c}").alias(c) for c in data])
        if late:
            live = live.where(filter_column(live, late))
        return live.select(*columns) if columns else live

    def compact(self, keys: Sequence[str], order: str = "version", buckets: int | None = None) -> int:
        """Store the live rows of the newest version bucketed by key; returns the version. ``order`` names the
        reads it serves: newest by ``version``, or by ``sequence`` of the data. Publications stay as they are."""
        version = self.version
        if any(c.base and c.version == version and c.order == order for c in self._entries()):
            return version
        by = ORDERS[order]
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        start = max((c.version for c in self.commits() if c.mode == "replace"), default=0)
        rows = self.rows(start - 1, version)
        data = [c for c in rows.columns if c not in META and c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*data, "_row", "_version"), F.struct(*by)).alias("__newest"))
        live = newest.select(*keys, "__newest.*")
        name = f"base_{uuid.uuid4().hex}"
        path = f"base/{name}"
        table = f"quantloom_{name}"
        live.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.folder}/{path}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        self._commit(f"{version:012d}-{order}", Commit(version, "upsert", path, live.schema.json(), base=True, buckets=buckets, order=order))
        return version

    def _buckets(self, base: Commit, keys: Sequence[str]) -> DataFrame:
        """The compacted rows, known to Spark as bucketed by ``keys``."""
        name = f"quantloom_open_{uuid.uuid4().hex}"
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in base.schema)
        place = f"{self.folder}/{base.path}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(map(quoted, keys))}) SORTED BY ({', '.join(map(quoted, keys))}) INTO {base.buckets} BUCKETS LOCATION '{place}'")
        try:
            return self.spark.table(name)
        finally:
            # The frame knows its files; the name is not needed any more and the files are not the table's.
            self.spark.sql(f"DROP TABLE {name}")


def open_log(spark: SparkSession, log: str) -> DataFrame:
    """The rows of all publications in a folder, stamped."""
    return Log(spark, log).rows()


def publish(spark: SparkSession, log: str, rows: DataFrame, keys: Sequence[str], mode: str = "upsert", sequence: str | None = None) -> int:
    """Write ``rows`` as the next version of the log in a folder (``Log.publish``); returns the version."""
    return Log(spark, log).publish(rows, keys, mode, sequence)


def grow(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stack two generations; new columns are null in old rows, dropping a column is refused."""
    lost = set(existing.columns) - set(incoming.columns)
    if lost:
        raise ContractError(f"columns cannot be dropped: {sorted(lost)}")
    return existing.unionByName(incoming, allowMissingColumns=True)


def versions(log: DataFrame) -> DataFrame:
    return log.agg(F.max("_version").alias("current_version"))


def split_filters(filters: Iterable | None, keys: Sequence[str]) -> tuple[list, list]:
    """Conditions on key columns alone, which may run before rows of a key are compared, and the others."""
    filters = list(filters or [])
    flat = bool(filters) and not isinstance(filters[0], list)
    early = [f for f in filters if f[0] in keys] if flat else []
    return early, [f for f in filters if f not in early]


def read(
    log: DataFrame, keys: Sequence[str], *, as_of: int | None = None, columns: Sequence[str] | None = None,
    filters: Iterable | None = None, by: Sequence[str] = ("_version", "_row"),
) -> DataFrame:
    """Newest row per key since the last replace, up to version ``as_of``.

    ``by=("_row", "_version")`` lets the sequence of the data decide across versions, so
    it does not matter how rows were dealt to publications.
    Filters apply to the deduplicated rows; conditions on key columns alone
    run before the aggregation, where the scan can use them. The newest row is
    a max by ``by``: it combines map-side, so a hot key is no hot task.
    """
    rows = log if as_of is None else log.where(F.col("_version") <= as_of)
    start = rows.where(F.col("_mode") == "replace").agg(F.coalesce(F.max("_version"), F.lit(-1))).scalar()
    early, late = split_filters(filters, keys)
    if early:
        rows = rows.where(filter_column(log, early))
    data = [c for c in log.columns if c not in META and c not in keys]
    live = (
        rows.where(F.col("_version") >= start)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*data), F.struct(*by)).alias("__newest"))
        .select(*keys, "__newest.*")
    )
    if late:
        live = live.where(filter_column(live, late))
    return live.select(*columns) if columns else live


def pinned(logs: dict[str, DataFrame], keys: dict[str, Sequence[str]], version: int) -> dict[str, DataFrame]:
    """Every table as of one version, for the length of a run."""
    return {name: read(log, keys[name], as_of=version) for name, log in logs.items()}


def iterate(df: DataFrame) -> Iterator:
    """Rows partition by partition; the driver holds one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)
